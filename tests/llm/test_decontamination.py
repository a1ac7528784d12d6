"""Decontamination by stated cases: copies in another case or place, slots in conflict."""

from lectern.llm import decontamination

ITEM = "In 1999 the river Avon carried 25 kg of sand past Bristol and then 25 kg of clay past Bath every single day"


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.covered, r.n_windows, r.reworded) for r in decontamination.leaks(docs, items).collect()}


def test_copies_in_another_case(spark):
    names = "When Tom met Ann in Paris they asked Bob and Eve why Max left Rome for Bonn with Kim and Joe"
    sharp = "the long Straße in Bonn was closed"
    docs = [ITEM.upper() + "!!", ITEM.lower(), names.upper(), names.lower(), "x y " + names.title(), sharp.upper()]
    got = found(spark, docs, [ITEM, names, sharp])
    assert got == {(0, 0): (19, 19, False), (1, 0): (19, 19, False), (2, 1): (17, 17, False), (3, 1): (17, 17, False), (4, 1): (17, 17, False), (5, 2): (3, 3, False)}
    assert set(found(spark, [ITEM], [ITEM.upper(), ITEM.lower()])) == {(0, 0), (0, 1)}


def test_short_items_anywhere(spark):
    short = "Who wrote Hamlet?"
    docs = ["Question: Who wrote Hamlet?", "A heading\nWho wrote Hamlet? Well.", "QUESTION: WHO WROTE HAMLET?", "they ask who wrote hamlet", "Who wrote Macbeth?", "Who read Hamlet?"]
    got = found(spark, docs, [short])
    assert {d for d, _ in got} == {0, 1, 2, 3, 4}
    assert [got[d, 0][2] for d in range(5)] == [False, False, False, False, True]


def test_two_parameters_fall_on_one_value(spark):
    item = "she has 3 apples and 7 pears in a bag and gives them all to the man at the door"
    got = found(spark, [item.replace("3", "5").replace("7", "5")], [item, "of 3 and 7"])
    assert got == {(0, 0): (16, 16, True)}


def test_unrelated_parameters_of_one_value(spark):
    item = "he bought 3 ripe red apples from the old market stall near the town hall for only 3 dollars and then walked home very happy"
    doc = item.replace("3 ripe", "4 ripe").replace("3 dollars", "5 dollars")
    assert found(spark, [doc], [item]) == {(0, 0): (16, 21, True)}
    assert found(spark, ["4 apples at 5 dollars"], ["3 apples at 3 dollars"]) == {}


def test_a_name_misspelt_once(spark):
    item = "then the river Avon carried sand past the town and the river Avon carried clay and the old Avon went by"
    got = found(spark, [item.replace("town and the river Avon", "town and the river Avno")], [item])
    assert got == {(0, 0): (12, 17, False)}

"""Stages and journals that are dealt once."""

from lectern.operators import journal
from lectern.operators import state as S


def test_stages_ready_from_one_row_a_book(spark):
    edges = spark.createDataFrame([("scan", None), ("tags", "scan"), ("publish", "tags"), ("publish", "scan")], "stage string, requires string")
    progress = spark.createDataFrame([(1, "scan", "succeeded"), (1, "tags", "failed"), (2, "scan", "skipped"), (2, "tags", "succeeded"), (3, "scan", "running"), (None, "scan", "succeeded")], "book_id long, stage string, status string")
    out = S.ready(edges.select("stage").distinct(), edges, progress)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "tags"), (2, "publish"), (None, "scan")], key=str)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("BroadcastExchange")[0]


def test_operations_with_one_number_are_marked_once(spark):
    state = spark.createDataFrame([("o", 1, "f", "a")], "target_kind string, target_id long, field string, value string")
    rows = [(7, "x", "o", 1, "f", "a", "b", "pending"), (7, "y", "o", 2, "f", "no", "c", "pending"), (8, "y", "o", 3, "f", None, "d", "done")]
    ops = spark.createDataFrame(rows, "op_id long, batch_id string, target_kind string, target_id long, field string, before string, after string, progress string")
    got = sorted((r.op_id, r.batch_id, r.progress) for r in journal.replayed(state, ops)[1].collect())
    assert got == [(7, "x", "done"), (7, "y", "failed"), (8, "y", "done")]

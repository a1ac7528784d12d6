"""Identity beyond names: evidence, the cascade, pending choices, aliases, tags, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.codes import ascii_lower
from lectern.functions.scalar import tag
from lectern.operators.consensus import corroborated, series_gaps
from lectern.operators.overlap import shared
from lectern.sources.versions import kept


#: Values of one array of a book's or an entity's.
LISTED = 2048

#: Rows of the largest table that a task gets of it when evidence is dealt out. They are two numbers each, so parts of as many bytes
#: as adaptive execution aims at hold millions, which take a hundred times their shuffled bytes in maps and sorts.
DEALT = 1 << 19


def _parts(*tables: DataFrame) -> int:
    """How many parts the tables' rows are dealt to: as many as the largest needs."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, *(-(-t.count() // DEALT) for t in tables))


def _joined(left: DataFrame, right: DataFrame, key: list[str], parts: int) -> DataFrame:
    """The rows of both with equal keys, both dealt out by them: the right side is not broadcast, however small its files are."""
    return left.repartition(parts, *key).join(right.repartition(parts, *key).hint("merge"), key)


def _lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values) of distinct rows (key, value): arrays of LISTED values at most, so a key may have several."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return rows.withColumn("part", F.floor((nth - 1) / LISTED)).groupBy(key, "part").agg(F.collect_list(value).alias("values")).drop("part")


def _elsewhere(pairs: DataFrame, of_book: DataFrame, of_entity: DataFrame, value: str, many: bool = False, parts: int | None = None) -> DataFrame:
    """(book_id, candidate) of pairs where the book shares a value with another book of the candidate. of_book (book_id, value);
    of_entity (candidate, value, book_id) is first brought to its least and largest book: another one is either of them.
    Large sides are dealt to that many parts (see _parts). A pair comes once for each of its rows and shared values.

    many: books have many values. A pair is then compared with lists of both sides instead of making a row for each value of
    the book; pairs of a candidate's own books, few for each book, are looked at by value. A pair comes once."""
    parts = parts or _parts(pairs, of_book)
    rows = of_book.where(F.col(value).isNotNull()).select("book_id", value).repartition(parts, "book_id", value).distinct()
    of_entity = of_entity.where(F.col("candidate").isNotNull() & F.col(value).isNotNull())
    held = of_entity.repartition(parts, "candidate", value).groupBy("candidate", value).agg(F.min("book_id").alias("low"), F.max("book_id").alias("high"))
    pairs = pairs.where("book_id IS NOT NULL AND candidate IS NOT NULL")
    if many:
        held, rows = kept(held), kept(rows)
        owned = of_entity.select("book_id", "candidate").distinct()
        mine, theirs = _lists(rows, "book_id", value).withColumnRenamed("values", "mine"), _lists(held.select("candidate", value), "candidate", value).withColumnRenamed("values", "theirs")
        others = pairs.join(owned, ["book_id", "candidate"], "left_anti").join(mine, "book_id").join(theirs, "candidate").where(F.arrays_overlap("mine", "theirs")).select("book_id", "candidate")
        pairs = pairs.join(owned, ["book_id", "candidate"], "left_semi")
    own = _joined(_joined(pairs, rows, ["book_id"], parts), held, ["candidate", value], parts).where("low <> book_id OR high <> book_id").select("book_id", "candidate")
    return own.unionByName(others).distinct() if many else own


def _total(found: Column, weights: list[float]) -> Column:
    """The sum of the weights i whose bit 2 ** i is set."""
    total = F.lit(0.0)
    for i, weight in enumerate(weights):
        total = total + F.when(found.bitwiseAND(F.lit(1 << i)) != 0, F.lit(weight)).otherwise(F.lit(0.0))
    return total


def _scored(pairs: DataFrame, evidence: list[tuple[DataFrame, float]], parts: int) -> DataFrame:
    """(book_id, candidate, score) of each of pairs once: the weights of the evidence (book_id, candidate; of pairs) that has it."""
    pair = ["book_id", "candidate"]
    rows = pairs.select(*pair, F.lit(0).alias("found"))
    for i, (found, _) in enumerate(evidence):
        rows = rows.unionByName(found.select(*pair, F.lit(1 << i).alias("found")))
    return rows.repartition(parts, *pair).groupBy(*pair).agg(F.bit_or("found").alias("found")).select(*pair, _total(F.col("found"), [w for _, w in evidence]).alias("score"))


#: Weights of evidence for authors: a narrator, the publisher and a series of another book of theirs.
AUTHOR = [0.4, 0.2, 0.5]


def _of_authors(pairs: DataFrame, books: DataFrame, book_narrator: DataFrame, book_series: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Candidates of each book and what speaks for them (bits as in AUTHOR), see overlap.shared."""
    narrators, series = book_narrator.select("book_id", "narrator_id"), book_series.select("book_id", "series_id")
    publisher = books.select(F.col("author_id").alias("candidate"), F.col("publisher_id").alias("value"), "book_id")
    kinds = [(narrators, None), (books.select("book_id", "publisher_id"), publisher), (series, None)]
    return shared(pairs, books.select("book_id", F.col("author_id").alias("candidate")), kinds, _parts(pairs, book_narrator, book_series), names)


def author_scores(pairs: DataFrame, books: DataFrame, book_narrator: DataFrame, book_series: DataFrame) -> DataFrame:
    """Evidence that candidates wrote a book: a narrator (0.4), publisher (0.2) or series (0.5) of another book of theirs."""
    rows = _of_authors(pairs, books, book_narrator, book_series).select("book_id", F.explode(F.arrays_zip("candidates", "found")).alias("x"))
    rows = rows.select("book_id", F.col("x.candidates").alias("candidate"), _total(F.col("x.found"), AUTHOR).alias("score"))
    return rows.unionByName(pairs.where("book_id IS NULL OR candidate IS NULL").select("book_id", "candidate").distinct().withColumn("score", F.lit(0.0)))


def narrator_scores(pairs: DataFrame, books: DataFrame, book_narrator: DataFrame) -> DataFrame:
    """Evidence for narrators: the publisher (0.2) of another book that they read."""
    parts = _parts(pairs, book_narrator)
    by = _joined(book_narrator.select(F.col("narrator_id").alias("candidate"), "book_id"), books.select("book_id", "publisher_id"), ["book_id"], parts)
    return _scored(pairs, [(_elsewhere(pairs, books, by, "publisher_id", parts=parts), 0.2)], parts)


def series_scores(pairs: DataFrame, books: DataFrame, book_series: DataFrame) -> DataFrame:
    """Evidence for series: the author (0.6) of another book in them."""
    parts = _parts(pairs, book_series)
    by = _joined(book_series.select(F.col("series_id").alias("candidate"), "book_id"), books.select("book_id", "author_id"), ["book_id"], parts)
    return _scored(pairs, [(_elsewhere(pairs, books, by, "author_id", parts=parts), 0.6)], parts)


def leading_authors(asked: DataFrame, entities: DataFrame, books: DataFrame, book_narrator: DataFrame, book_series: DataFrame, margin: float = 0.3) -> DataFrame:
    """(book_id, entity_id): for each of asked (book_id, name_key) the candidate whose evidence (see author_scores) leads that of all
    others of the name by more than the margin. entities (name_key, candidate): two at least for each name; a book is in books once.

    Candidates are not paired with all books. What decides are the two best scores, and a short list has them: all with a series, two
    with a narrator, and where fewer than two have one, two with the publisher and two of any kind. A leader that one with narrator and
    publisher could still catch is checked against such ones: those listed first, then all for books that are left."""
    known = books.join(entities.select("name_key", F.col("candidate").alias("author_id")), "author_id").select("name_key", F.col("author_id").alias("candidate"), "book_id", "publisher_id")
    narrated = book_narrator.select("book_id", "narrator_id").where("narrator_id IS NOT NULL").distinct()
    in_series = book_series.select("book_id", "series_id").where("series_id IS NOT NULL").distinct()
    publisher = books.select("book_id", "publisher_id").where("publisher_id IS NOT NULL")
    held = lambda rows, value: rows.groupBy("name_key", "candidate", value).agg(F.min("book_id").alias("low"), F.max("book_id").alias("high"))
    another = "low <> book_id OR high <> book_id"
    by_narrator = kept(held(known.join(narrated, "book_id"), "narrator_id"))
    by_publisher = kept(held(known.where("publisher_id IS NOT NULL"), "publisher_id"))

    def few(rows: DataFrame, value: str) -> DataFrame:
        # A book is no other one for its own author only, so of three at least two count.
        nth = F.row_number().over(Window.partitionBy("name_key", value).orderBy("candidate"))
        return rows.withColumn("nth", nth).where("nth <= 3").drop("nth")

    few_narrated = kept(few(by_narrator, "narrator_id"))
    asked = kept(asked.select("book_id", "name_key").distinct())
    near = asked.join(narrated, "book_id").join(few_narrated, ["name_key", "narrator_id"]).where(another).groupBy("book_id", "name_key").agg(F.min("candidate").alias("a"), F.max("candidate").alias("b"))
    near = kept(asked.join(near, ["book_id", "name_key"], "left"))
    serial = kept(asked.join(in_series, "book_id").join(held(known.join(in_series, "book_id"), "series_id"), ["name_key", "series_id"]).where(another).select("book_id", "candidate").distinct())
    thin, dense = near.where("a IS NULL OR a = b"), near.where("a < b")
    pair = lambda rows, a, b: rows.select("book_id", F.explode(F.array(a, b)).alias("candidate")).where("candidate IS NOT NULL")
    published = thin.join(publisher, "book_id").join(few(by_publisher, "publisher_id"), ["name_key", "publisher_id"]).where(another).select("book_id", "candidate")
    some = thin.join(entities.groupBy("name_key").agg(F.min("candidate").alias("first"), F.max("candidate").alias("last")), "name_key")
    short = serial.unionByName(pair(thin, "a", "b")).unionByName(pair(dense.join(serial, "book_id", "left_semi"), "a", "b")).unionByName(published).unionByName(pair(some, "first", "last"))
    scores = author_scores(kept(short.distinct()), books, book_narrator, book_series)
    leaders = kept(corroborated(scores.withColumnRenamed("candidate", "entity_id"), "book_id", margin))

    def caught(rows: DataFrame, narrators: DataFrame) -> DataFrame:
        others = rows.join(narrated, "book_id").join(narrators, ["name_key", "narrator_id"]).where(another).where("candidate <> entity_id").select("book_id", "candidate").distinct()
        others = others.join(publisher, "book_id").join(by_publisher.drop("name_key").distinct(), ["candidate", "publisher_id"])
        return others.where(another).select("book_id").distinct()

    open_ = kept(leaders.where(F.col("score") - F.lit(0.4 + 0.2) <= margin).join(dense.select("book_id", "name_key"), "book_id"))
    listed = kept(caught(open_, few_narrated))
    rest = kept(open_.join(listed, "book_id", "left_anti"))
    return leaders.join(listed, "book_id", "left_anti").join(caught(rest, by_narrator), "book_id", "left_anti").select("book_id", "entity_id")


def cascade(names: DataFrame, known: DataFrame, leading) -> DataFrame:
    """names (row_id, name, external_id) resolved against known (entity_id, alias, external_id): by external id; by an alias in any
    ASCII case that one entity has; of several the one whose evidence leads by the margin, else deferred; new names get an id by
    hash, equal names the same. leading: (book_id, name_key) and (name_key, candidate) to (book_id, entity_id), see leading_authors."""
    key = lambda c: ascii_lower(F.trim(F.col(c)))
    ids = known.where("external_id IS NOT NULL").groupBy("external_id").agg(F.min("entity_id").alias("by_id"))
    entities = known.select(key("alias").alias("name_key"), F.col("entity_id").alias("candidate")).distinct()
    counts = entities.groupBy("name_key").agg(F.count("*").alias("n"), F.min("candidate").alias("only"))
    rows = names.withColumn("name_key", key("name")).join(ids, "external_id", "left").join(counts, "name_key", "left")
    several = rows.where("by_id IS NULL AND n > 1").select(F.col("row_id").alias("book_id"), "name_key")
    shared = entities.join(counts.where("n > 1").select("name_key"), "name_key", "left_semi")
    chosen = leading(several, shared).select(F.col("book_id").alias("row_id"), F.col("entity_id").alias("by_evidence"))
    rows = rows.join(chosen, "row_id", "left")
    alone = F.col("n") == 1
    outcome = F.when(F.col("by_id").isNotNull(), "external").when(alone, "alias").when(F.col("by_evidence").isNotNull(), "corroborated").when(F.col("n") > 1, "deferred").otherwise("new")
    new_id = F.when(F.col("n").isNull(), F.xxhash64("name_key").bitwiseOR(F.lit(1 << 62)))
    return rows.select("row_id", "name", outcome.alias("outcome"), F.coalesce("by_id", F.when(alone, F.col("only")), "by_evidence", new_id).alias("entity_id"))


def _best_first(c: Column) -> Column:
    """An array of (order, id, display, score) as (id, display, score), sorted."""
    return F.transform(F.array_sort(c), lambda x: F.struct(x["id"].alias("id"), x["display"].alias("display"), x["score"].alias("score")))


def pending(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Per book, its candidates (id, display, score), best first, as a list that someone has to choose from. scores (book_id,
    candidate, score), names (candidate, display)."""
    row = F.struct((-F.col("score")).alias("order"), F.col("candidate").alias("id"), "display", "score")
    return scores.join(names, "candidate").groupBy("book_id").agg(_best_first(F.collect_list(row)).alias("candidates"))


def pending_authors(pairs: DataFrame, books: DataFrame, book_narrator: DataFrame, book_series: DataFrame, names: DataFrame) -> DataFrame:
    """pending() of author_scores(), listed and named where a book's candidates are looked at."""

    def row(x: Column) -> Column:
        score = _total(x["found"], AUTHOR)
        return F.struct((-score).alias("order"), x["candidates"].alias("id"), x["displays"].alias("display"), score.alias("score"))

    lists = _of_authors(pairs, books, book_narrator, book_series, names).where(F.size("candidates") > 0)
    rows = lists.select("book_id", _best_first(F.transform(F.arrays_zip("candidates", "found", "displays"), row)).alias("candidates"))
    bookless = pairs.where("book_id IS NULL AND candidate IS NOT NULL").select("book_id", F.col("candidate").cast("long").alias("candidate")).distinct()
    return rows.unionByName(pending(bookless.withColumn("score", F.lit(0.0)), names.select("candidate", F.col("display").cast("string").alias("display"))))


def exalted(aliases: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """aliases (key, alias, is_prime) with the chosen ones (key, alias) prime and their key's others not; those that aren't there
    yet are added. Aliases are the same in any ASCII case."""
    own = chosen.select(key, F.col("alias").alias("wanted"))
    same = ascii_lower(F.col("alias")) == ascii_lower(F.col("wanted"))
    out = aliases.join(own, key, "left").withColumn("is_prime", F.when(F.col("wanted").isNull(), F.col("is_prime")).otherwise(same)).select(key, "alias", "is_prime")
    held = aliases.select(key, ascii_lower(F.col("alias")).alias("low"))
    added = chosen.withColumn("low", ascii_lower(F.col("alias"))).join(held, [key, "low"], "left_anti").select(key, "alias", F.lit(True).alias("is_prime"))
    return out.unionByName(added)


def split_aliases(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, alias): the lines of a column, trimmed, without blanks, once each."""
    return rows.select(key, F.explode(F.split(column, "\n")).alias("alias")).select(key, F.trim("alias").alias("alias")).where("alias <> ''").distinct()


def gaps_of_authors(books: DataFrame, book_series: DataFrame) -> DataFrame:
    """(author_id, series_id, missing): whole positions missing in series of an author's books."""
    gaps = series_gaps(book_series.select("series_id", "position").where("position IS NOT NULL"), "series_id").where(F.size("missing") > 0).select("series_id", "missing")
    return book_series.join(books.select("book_id", "author_id"), "book_id").select("author_id", "series_id").distinct().join(gaps, "series_id")


def tag_pairs(raw: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """raw (key, place, parent, child) as normalised pairs of the key's own tags (key, tag), once each, none with itself, in order;
    pairs that lead back from the child to the parent over earlier pairs are for the caller's closure to find."""
    rows = raw.select(key, "place", tag(F.col("parent")).alias("parent"), tag(F.col("child")).alias("child")).where("parent <> '' AND child <> '' AND parent <> child")
    own = tags.select(key, tag(F.col("tag")).alias("tag")).distinct()
    rows = rows.join(own.withColumnRenamed("tag", "parent"), [key, "parent"], "left_semi").join(own.withColumnRenamed("tag", "child"), [key, "child"], "left_semi")
    return rows.groupBy(key, "parent", "child").agg(F.min("place").alias("place"))


#: Labels and severities of content warnings (fixed values).
WARNINGS = """violence sexual_content sexual_assault graphic_sex addiction substance_abuse suicide self_harm child_endangerment child_abuse gore torture
animal_cruelty animal_death eating_disorder body_horror kidnapping stalking domestic_abuse racism homophobia transphobia ableism war death grief
medical_trauma pregnancy_loss mental_illness religious_trauma""".split()
SEVERITIES = ["mild", "moderate", "intense", "graphic"]


def warnings(raw: DataFrame, key: str) -> DataFrame:
    """raw (key, place, label, severity) as (key, label, severity): known labels and severities only, a label's first one."""
    label = F.replace(ascii_lower(F.trim("label")), F.lit(" "), F.lit("_"))
    rows = raw.select(key, "place", label.alias("label"), ascii_lower(F.trim("severity")).alias("severity")).where(F.col("label").isin(WARNINGS) & F.col("severity").isin(SEVERITIES))
    return rows.groupBy(key, "label").agg(F.min_by("severity", "place").alias("severity"))


def valid_reply(language: Column, of_book: Column, steps: Column) -> Column:
    """Whether a reply is in the book's language (or one of the same primary code) and its steps are numbered 1 to n."""
    primary = lambda c: ascii_lower(F.substring_index(c, "-", 1))
    return F.coalesce((primary(language) == primary(of_book)) & (F.size(steps) > 0) & (steps == F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)))), F.lit(False))

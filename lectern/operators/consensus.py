"""Consensus over competing metadata and resolution of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.codes import ascii_lower


def winners(candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each key with a value, in a total order."""
    by = Window.partitionBy(*key).orderBy(*order)
    return candidates.where("value IS NOT NULL").withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def best_values(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Per key and value, its largest confidence and the candidate that has it (the latest on a tie)."""
    order = F.struct("confidence", "recorded_at", "candidate_id")
    return candidates.groupBy(*key, "value").agg(F.max("confidence").alias("confidence"), F.max(order).getField("candidate_id").alias("candidate_id"))


def retention(rows: DataFrame, key: list[str], order: list[Column], when: Column, latest: Column, others: Column) -> DataFrame:
    """What two-tier retention would drop: the newest of a key before `latest`, the rest before `others`."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rn", rn).where(((F.col("rn") == 1) & (when < latest)) | ((F.col("rn") > 1) & (when < others))).drop("rn")


def by_precedence(rows: DataFrame, key: str, source: str, order: list[str]) -> DataFrame:
    """Per key, the source that comes first in `order`; unknown sources are ignored."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    return rows.where(rank > 0).groupBy(key).agg(F.min_by(source, rank).alias("winner"))


def distinct_values(candidates: DataFrame, key: str) -> DataFrame:
    """Per key, values distinct in any case of letters, each as its best candidate wrote it."""
    by = Window.partitionBy(key, F.lower(F.trim("value"))).orderBy(F.desc("confidence"), F.desc("recorded_at"), F.desc("candidate_id"))
    return candidates.where(F.trim("value") != "").withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def series_groups(candidates: DataFrame) -> DataFrame:
    """Per book and series name (trimmed, any case): of candidates by confidence, the first name, the first asin
    and position that are there, and whether any is primary."""
    order = F.struct(-F.col("confidence"), F.col("candidate_id"))
    first = lambda c, ok: F.min(F.when(ok, F.struct(order.alias("o"), F.col(c).alias("v")))).getField("v")
    return candidates.groupBy("book_id", F.lower(F.trim("name")).alias("series_key")).agg(
        F.min(F.struct(order.alias("o"), F.trim("name").alias("v"))).getField("v").alias("name"),
        first("asin", F.coalesce(F.col("asin"), F.lit("")) != "").alias("asin"), first("position", F.col("position").isNotNull()).alias("position"),
        F.bool_or("is_primary").alias("is_primary"),
    )


def resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (row_id, name, external_id) against known (entity_id, alias, external_id): by external id, else by an alias
    that one entity has; `outcome` is external, alias, ambiguous or new."""
    ids = known.where("external_id IS NOT NULL").groupBy("external_id").agg(F.min("entity_id").alias("by_id"))
    aliases = known.groupBy(ascii_lower(F.trim("alias")).alias("alias_key")).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("by_alias"))
    out = names.join(ids, "external_id", "left").join(aliases, ascii_lower(F.trim("name")) == F.col("alias_key"), "left")
    outcome = F.when(F.col("by_id").isNotNull(), "external").when(F.col("n") == 1, "alias").when(F.col("n") > 1, "ambiguous").otherwise("new")
    return out.select("row_id", "name", outcome.alias("outcome"), F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_alias"))).alias("entity_id"))


def corroborated(scores: DataFrame, key: str, margin: float = 0.3) -> DataFrame:
    """Per key, the candidate whose score leads the next by more than the margin; a lone one always."""
    by = Window.partitionBy(key).orderBy(F.desc("score"), "entity_id")
    ranked = scores.select("*", F.row_number().over(by).alias("rank"), F.lead("score").over(by).alias("next"))
    return ranked.where((F.col("rank") == 1) & (F.col("next").isNull() | (F.col("score") - F.col("next") > margin))).select(key, "entity_id", "score")


def gap_ranges(positions: DataFrame, key: str) -> DataFrame:
    """(key, first, last): runs of whole numbers missing between neighbouring whole positions of a series, a row each however long."""
    p = F.col("position")
    whole = positions.where((F.abs(p - F.round(p)) < 1e-6) & (p >= 0)).select(key, F.round(p).cast("long").alias("at")).distinct()
    rows = whole.withColumn("next", F.lead("at").over(Window.partitionBy(key).orderBy("at"))).where("next > at + 1")
    return rows.select(key, (F.col("at") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def classes(rows: DataFrame, key: str, by: Column) -> DataFrame:
    """(key, class, n) of rows that share `by` with another: the class is its smallest key; a row each, so a class of any size is dealt out."""
    held = rows.select(key, by.alias("by")).distinct()
    groups = held.groupBy("by").agg(F.min(key).alias("class"), F.count("*").alias("n")).where("n > 1 and by is not null")
    return held.join(groups, "by").select(key, "class", "n")


def series_gaps(positions: DataFrame, key: str) -> DataFrame:
    """Per series, whole numbers missing between its least and largest whole position, and its fractional positions."""
    p = F.col("position")
    whole = F.collect_set(F.when((F.abs(p - F.round(p)) < 1e-6) & (p >= 0), F.round(p).cast("long")))
    rows = positions.groupBy(key).agg(whole.alias("whole"), F.array_sort(F.collect_set(F.when(F.abs(p - F.round(p)) >= 1e-6, p))).alias("fractional"))
    inside = F.sequence(F.array_min("whole"), F.array_max("whole"))
    missing = F.when(F.size("whole") >= 2, F.array_sort(F.array_except(inside, "whole"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select(key, missing.alias("missing"), "fractional")


def franchise_prefix(titles: DataFrame, key: str) -> DataFrame:
    """Per key with two titles or more, the prefix that all share, cut after its last delimiter, if 4 bytes or more. The
    least and largest title have the shared prefix of all."""
    ends = titles.groupBy(key).agg(F.min("title").alias("a"), F.max("title").alias("b"), F.count("*").alias("n")).where("n >= 2")
    n = F.least(F.char_length("a"), F.char_length("b"))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("a"), F.lit(1), i) == F.substring(F.col("b"), F.lit(1), i))
    rows = ends.withColumn("prefix", F.substring("a", F.lit(1), F.array_max(same)))
    cut = F.lit(None).cast("string")
    for mark in (" — ", " - ", ": "):
        at = F.char_length("prefix") - F.instr(F.reverse("prefix"), mark[::-1]) + 1
        cut = F.when(F.contains(F.col("prefix"), F.lit(mark)), F.substring("prefix", F.lit(1), at)).otherwise(cut)
    return rows.select(key, F.when(F.octet_length(cut) >= 4, cut).alias("prefix"))


def descendants(edges: DataFrame, start: Column | None = None) -> DataFrame:
    """(ancestor, node) pairs reachable over edges (parent, child), cycles included: a join a level until nothing is new. Levels are
    checkpointed, so the caller has set a checkpoint folder."""
    seen = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node")).distinct()
    if start is not None:
        seen = seen.where(start)
    step = seen
    while True:
        step = step.join(edges, F.col("node") == F.col("parent")).select("ancestor", F.col("child").alias("node")).distinct().join(seen, ["ancestor", "node"], "left_anti").checkpoint()
        if not step.limit(1).count():
            return seen
        seen = seen.unionByName(step).checkpoint()

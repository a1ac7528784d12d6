"""Tag hierarchies: edges taken in order, each only if it closes no cycle over those taken before it.

Whether an edge is taken hangs on those before it, so a decision can't be made for all at once. Two things keep that
small. Edges that can lie on no cycle at all are taken together: an edge whose child has no children, or whose parent has
no parents, is dropped from the question, round by round. The rest go in batches of BATCH edges: one walk over the
edges taken so far finds which children of the batch reach which of its parents (by joins, a round a level), and the batch
is decided from these pairs alone, BATCH * BATCH at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.versions import kept

BATCH, PEELS = 512, 12


def on_cycles(edges: DataFrame, rounds: int = PEELS) -> DataFrame:
    """edges (parent, child, ..) without those that some rounds show to be on no cycle."""
    n = edges.count()
    for _ in range(rounds):
        left = edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        left = kept(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select(*edges.columns))
        m = left.count()
        if m == n:
            break
        edges, n = left, m
    return edges


def reached(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(start, target) where a walk over edges (parent, child) leads from one of starts (tag) to one of targets (tag)."""
    seen = step = kept(starts.select(F.col("tag").alias("start"), F.col("tag").alias("at")).distinct())
    while True:
        step = kept(step.join(edges, F.col("at") == F.col("parent")).select("start", F.col("child").alias("at")).distinct().join(seen, ["start", "at"], "left_anti"))
        if not step.limit(1).count():
            return seen.join(targets.select(F.col("tag").alias("at")).distinct(), "at", "left_semi").select("start", F.col("at").alias("target"))
        seen = kept(seen.unionByName(step))


def decided(batch: list[tuple[str, str]], ways: set[tuple[str, str]]) -> list[bool]:
    """Which edges (parent, child) of a batch are taken, in order. ways: (start, end) pairs that the edges taken before lead along."""
    taken: list[tuple[str, str]] = []
    out = []
    for parent, child in batch:
        open_, seen, good = [child], {child}, True
        while open_ and good:
            at = open_.pop()
            good = at != parent and (at, parent) not in ways
            for p, c in taken:
                if c not in seen and (at == p or (at, p) in ways):
                    seen.add(c)
                    open_.append(c)
        if good:
            taken.append((parent, child))
        out.append(good)
    return out


def accepted(existing: DataFrame, new: DataFrame, batch: int = BATCH) -> DataFrame:
    """new (place, parent, child) with `taken`: whether the edge, in order of place, parent and child, closes no cycle
    over existing (parent, child) and the new ones taken before. An edge is decided once, at its first place; one that exists
    already, or leads to itself, is not taken."""
    spark = new.sparkSession
    first = new.groupBy("parent", "child").agg(F.min("place").alias("place")).where("parent is not null and child is not null")
    first = kept(first.join(existing.select("parent", "child").distinct(), ["parent", "child"], "left_anti").where("parent <> child"))
    old = existing.select("parent", "child").distinct()
    every = kept(old.withColumn("place", F.lit(None).cast(first.schema["place"].dataType)).unionByName(first))
    asked = on_cycles(every)
    edges = asked.where("place is null").select("parent", "child")
    order = ["place", "parent", "child"]
    # Numbered by ranges of places, so no task sorts all: the count before each range, and the place in it.
    rows = asked.where("place is not null").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = kept(rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    sizes = dict(rows.groupBy("part").count().collect())
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if total:
        start = spark.createDataFrame(list(before.items()), "part int, start long")
        rows = kept(rows.join(F.broadcast(start), "part").select("parent", "child", "place", (F.col("nth") + F.col("start")).alias("nth")))
    refused = []
    for low in range(0, total, batch):
        own = rows.where((F.col("nth") > low) & (F.col("nth") <= low + batch)).orderBy("nth").select("parent", "child")
        pairs = [tuple(r) for r in own.collect()]
        tags = [spark.createDataFrame([(t,) for t in {p[i] for p in pairs}], "tag string") for i in (1, 0)]
        ways = {tuple(r) for r in reached(edges, *tags).collect()} if edges.limit(1).count() else set()
        ways = {w for w in ways if w[0] != w[1]}
        good = decided(pairs, ways)
        took = [p for p, g in zip(pairs, good, strict=True) if g]
        refused.append([p for p, g in zip(pairs, good, strict=True) if not g])
        if took:
            edges = edges.unionByName(spark.createDataFrame(took, "parent string, child string"))
            edges = kept(edges)
    bad = None
    for some in refused:
        if some:
            part = spark.createDataFrame(some, "parent string, child string")
            bad = part if bad is None else bad.unionByName(part)
    out = first.select("place", "parent", "child")
    if bad is None:
        return out.withColumn("taken", F.lit(True))
    return out.join(bad.withColumn("no", F.lit(True)), ["parent", "child"], "left").select("place", "parent", "child", F.col("no").isNull().alias("taken"))

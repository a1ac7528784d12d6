"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import delete_path, discard, new_path, written


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each id in links (a, b): label is the smallest id reachable.

    Each round takes the smallest label among neighbours, then the label's own label, so paths halve;
    it ends when a round changes none. Labels of each round are a written table: nothing is collected
    but a count, and lineage doesn't grow. Ids without links don't appear. Hot ids are pre-aggregated
    (a partial min), and the join's sides are both shuffled, so AQE can split one with many links.
    """
    spark = links.sparkSession
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    start = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
    path = new_path(spark, "labels")
    start.write.parquet(path)
    schema = "id bigint, label bigint"
    while True:
        labels = spark.read.schema(schema).parquet(path)
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.id == near.a).select("id", F.least("label", "m").alias("low"), "label")
        up = labels.select(F.col("id").alias("at"), F.col("label").alias("up"))
        new = low.join(up, low.low == up.at, "left").select("id", F.least("low", F.coalesce("up", "low")).alias("new"), "label")
        to = new_path(spark, "labels")
        new.select("id", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")).write.parquet(to)
        moved = spark.read.parquet(to).where("moved").limit(1).count()
        delete_path(spark, path)
        path = to
        if not moved:
            discard(both)
            out = spark.read.schema(schema).parquet(path)
            out.written_to = path
            return out

"""Seed files of the signature library: JSON lists of findings, read with a schema; what is broken is set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a finding (fixed values).
FINDING = (
    "publisher string, title string, intro_publisher_match string, outro_publisher_match string, intro_transcript string, outro_transcript string, "
    "intro_fingerprint_b64 string, outro_fingerprint_b64 string, intro_fingerprint_duration_ms bigint, outro_fingerprint_duration_ms bigint"
)


def findings(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with `finding`, and `broken` where the text is no JSON object of these fields and types."""
    row = F.from_json(column, f"{FINDING}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    short = lambda c: F.coalesce((c < 0) | (c >= 1 << 32), F.lit(False))
    rows = texts.withColumn("finding", row)
    broken = F.col("finding").isNull() | F.col("finding._bad").isNotNull() | F.json_object_keys(column).isNull()
    broken = broken | short(F.col("finding.intro_fingerprint_duration_ms")) | short(F.col("finding.outro_fingerprint_duration_ms"))
    rows = rows.withColumn("broken", broken)
    return rows.withColumn("finding", F.when(~F.col("broken"), F.col("finding").dropFields("_bad")))


def fingerprints(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep.., publisher, publisher_match, position, fingerprint_b64, duration_ms, transcript_excerpt, confirmed): an intro and an outro
    of each finding that has one; none is confirmed yet."""
    def end(position: str) -> Column:
        f = lambda name: F.col(f"finding.{position}_{name}")
        return F.struct(
            F.col("finding.publisher").alias("publisher"), f("publisher_match").alias("publisher_match"), F.lit(position).alias("position"), f("fingerprint_b64").alias("fingerprint_b64"),
            F.coalesce(f("fingerprint_duration_ms"), F.lit(0)).alias("duration_ms"), f("transcript").alias("transcript_excerpt"), F.lit(False).alias("confirmed"))

    good = rows.where("not broken").select(*keep, F.explode(F.array(end("intro"), end("outro"))).alias("p"))
    return good.where("p.fingerprint_b64 <> ''").select(*keep, "p.*")


def seed_files(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprints with their path, broken (path, text)): each file a list of findings. A file that isn't one, truncated ones for
    instance, is a broken row, and the others are read. Only names that end in .json are taken."""
    wrong = [p for p in paths if not p.lower().endswith(".json")]
    if wrong:
        raise ValueError(f"not a .json file: {wrong[0]}")
    whole = spark.read.option("wholetext", "true").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("whole"))
    items = whole.withColumn("items", F.from_json("whole", "array<string>", {"mode": "PERMISSIVE"}))
    good = F.col("items").isNotNull() & F.ltrim("whole").startswith("[") & F.rtrim("whole").endswith("]")
    rows = findings(items.where(good).select("path", F.explode("items").alias("value")))
    broken = items.where(~good).select("path", F.col("whole").alias("text")).unionByName(rows.where("broken").select("path", F.col("value").alias("text")))
    return fingerprints(rows, "path"), broken


def by_publisher(seeds: DataFrame) -> DataFrame:
    """(publisher, intros, outros, confirmed)"""
    key = F.coalesce("publisher", F.lit("(no publisher)")).alias("publisher")
    return seeds.groupBy(key).agg(F.count_if(F.col("position") == "intro").alias("intros"), F.count_if(F.col("position") == "outro").alias("outros"), F.count_if("confirmed").alias("confirmed"))

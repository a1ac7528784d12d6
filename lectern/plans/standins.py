"""Library tables over the driver's tables: expressions that Spark and DuckDB read alike, so a query and its
oracle start from the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.versions import shared_folder

#: name: (table, where, {column: expression})
TABLES: dict[str, tuple[str, str, dict[str, str]]] = {
    "books": ("part", "true", {
        "book_id": "p_partkey", "title": "p_name", "subtitle": "p_type",
        "language": "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'de' WHEN p_partkey % 3 = 0 THEN 'fr' ELSE 'en' END",
        "author_id": "CAST(floor(p_partkey / 20) AS BIGINT)", "publisher_id": "p_partkey % 27",
        "duration_ms": "CASE WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 2700000 END",
        "reading_status": "CASE p_partkey % 5 WHEN 0 THEN 'unread' WHEN 1 THEN 'reading' WHEN 2 THEN 'finished' WHEN 3 THEN 'dnf' ELSE 'unread' END",
        "rating": "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 END",
        "abridged": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 = 1 END",
        "audiologo_status": "CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'candidate' ELSE 'applied' END",
        "release_date": "CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 8 = 0 THEN 'abc' ELSE concat(CAST(1950 + p_partkey % 77 AS VARCHAR(9)), '-03-04') END",
        "created_at": "CAST('2015-01-01 00:00:00' AS TIMESTAMP) + p_partkey % 3000 * INTERVAL '1' DAY",
        "deleted_at": "CASE WHEN p_partkey % 17 = 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) END",
        "price": "p_retailprice",
    }),
    "authors": ("supplier", "true", {"author_id": "s_suppkey", "name": "s_name"}),
    "author_aliases": ("supplier", "true", {"author_id": "s_suppkey", "alias": "concat('Pen ', s_name)", "is_prime": "s_suppkey % 6 = 0"}),
    "publishers": ("nation", "true", {"publisher_id": "CAST(n_nationkey AS BIGINT)", "name": "n_name"}),
    "series": ("part", "true", {"series_id": "p_partkey", "name": "concat('Saga ', p_name)"}),
    "series_aliases": ("part", "true", {"series_id": "p_partkey", "alias": "concat('The ', p_name)", "is_prime": "p_partkey % 8 = 0"}),
    "book_series": ("part", "true", {"book_id": "p_partkey", "series_id": "CAST(floor(p_partkey / 7) AS BIGINT) * 3", "position": "CAST(p_partkey % 9 AS DOUBLE) + CASE WHEN p_partkey % 10 = 1 THEN 0.5 ELSE 0 END", "is_primary": "p_partkey % 4 <> 0"}),
    "book_narrator": ("lineitem", "true", {"book_id": "l_partkey", "narrator_id": "l_suppkey"}),
    "files": ("lineitem", "true", {
        "file_id": "l_partkey * 100000000 + l_orderkey * 10 + l_linenumber", "book_id": "l_partkey", "format": "CASE l_returnflag WHEN 'A' THEN 'M4B' WHEN 'N' THEN 'mp3' ELSE 'Flac' END",
        "duration_ms": "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 60000 END", "is_active": "l_linestatus = 'O'", "size": "CAST(floor(l_extendedprice) AS BIGINT)",
    }),
    "candidates": ("lineitem", "true", {
        "book_id": "l_orderkey", "field": "l_returnflag", "value": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linestatus END", "confidence": "l_discount", "recorded_at": "l_shipdate",
        "candidate_id": "l_partkey * 100 + l_linenumber", "source": "CASE l_suppkey % 4 WHEN 0 THEN 'catalog' WHEN 1 THEN 'embedded' WHEN 2 THEN 'cue' ELSE 'other' END",
    }),
    "chapters": ("lineitem", "true", {"book_id": "l_orderkey", "idx": "CAST(l_linenumber AS BIGINT)", "length_ms": "CAST(l_quantity AS BIGINT) * 1000", "title": "concat('Chapter ', CAST(l_linenumber AS VARCHAR(9)))"}),
    "segments": ("conversations", "true", {"book_id": "conv_id", "idx": "turn", "speaker": "role", "said": "text"}),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, where, columns = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").where(where)
    return rows.selectExpr(*[f"{e.replace('AS TIMESTAMP)', 'AS TIMESTAMP_NTZ)').replace('AS VARCHAR(9))', 'AS STRING)')} AS {c}" for c, e in columns.items()])


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder (sources.versions)."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def with_(*names: str) -> str:
    """A WITH clause that defines the tables for an oracle."""
    parts = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TABLES[n][2].items())} FROM {TABLES[n][0]} WHERE {TABLES[n][1]})" for n in names]
    return "WITH " + ", ".join(parts) + " "

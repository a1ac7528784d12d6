"""Facets on rows whose keys repeat."""

from lectern.plans import catalog


def test_repeated_file_ids_count_each(spark, tmp_path):
    spark.sql("SELECT 5L AS p_partkey, 'x' AS p_name, 'T' AS p_type, 1 AS p_size, 1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 5, 1, 1, 1.0, 1.0, "A", "O"), (1, 5, 2, 1, 1.0, 1.0, "N", "F"), (2, 5, 2, 1, 1.0, 1.0, "R", "O")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(catalog.QUERIES["facet_format"](spark, str(tmp_path)).collect()) == [("m4b", 1, 50.0), ("mp3", 1, 50.0)]

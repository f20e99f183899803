"""Declared scans: what reaches the files, and an error of its own for each way a source can be wrong."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from terrane.sources import readers
from terrane.sources.scans import Declared, MalformedSourceError, MissingSourceError, between, scan


def test_conditions_and_columns_reach_the_scan(spark):
    rows = scan(spark, f"{SF}/part.parquet", Declared("p_partkey bigint, p_size int, p_retailprice double", ("p_size",)), F.col("p_size").isin(3, 4, 5) & between("p_retailprice", 901.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = rows.select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "In(p_size, [3,4,5])" in plan and "GreaterThanOrEqual(p_retailprice,901.0)" in plan and "IsNotNull(p_size)" in plan
    assert "p_name" not in plan and all(r.p_size in (3, 4, 5) and r.p_retailprice >= 901 for r in rows.collect())
    assert scan(spark, f"{SF}/part.parquet", Declared("p_partkey bigint")).columns == ["p_partkey"]


def test_errors_of_sources(spark, tmp_path):
    with pytest.raises(MissingSourceError):
        scan(spark, str(tmp_path / "absent.parquet"), Declared("a int"))
    (tmp_path / "bad.parquet").write_text("no parquet at all, but long enough to be opened")
    with pytest.raises(MalformedSourceError):
        scan(spark, str(tmp_path / "bad.parquet"), Declared("a int"))
    with pytest.raises(readers.SchemaDriftError, match="p_size: int, declared string; nothing: absent"):
        scan(spark, f"{SF}/part.parquet", Declared("p_partkey bigint, p_size string, nothing int"))
    with pytest.raises(MissingSourceError):
        readers.read_strict_csv(spark, str(tmp_path / "absent.csv"), ["a"])
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(readers.SchemaDriftError):
        readers.read_strict_csv(spark, str(tmp_path / "t.csv"), ["a"])

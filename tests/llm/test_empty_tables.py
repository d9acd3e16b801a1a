"""Queries of the problems on training data over tables without rows, and over rows that hold nothing."""

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["raw_edges", "connection_count_panel", "panel_with_returns", "documents", "mix_targets"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    """Each table with three rows of nulls, and a column more."""
    root = tmp_path_factory.mktemp("nulls")
    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet").limit(3)
        df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.lit(1).alias("n")).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_only_nulls(spark, nulls, name):
    got = queries.QUERIES[name](spark, nulls).collect()
    if name == "p8_ids":
        assert [tuple(r) for r in got] == [(None, [])]
    else:
        assert got == []

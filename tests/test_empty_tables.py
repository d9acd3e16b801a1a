"""The record queries over tables without rows."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_record_queries_on_empty_tables(spark, tmp_path):
    from tidewheel.plans import records

    for f in ("raw_edges", "merged_panel", "panel_with_returns", "fundamentals", "connection_count_panel", "ceo_sample", "linking_table"):
        spark.read.parquet(f"{SF}/{f}.parquet").limit(0).write.parquet(f"{tmp_path}/{f}.parquet")
    for name, query in records.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name

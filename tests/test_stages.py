import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import etl
from tidewheel.sources import config, io
from tidewheel.streaming.returns import streaming_annual_returns


def test_chunks_and_batches():
    c = io.date_chunks(dt.date(2000, 1, 1), dt.date(2000, 1, 25), 10)
    assert c == [(dt.date(2000, 1, 1), dt.date(2000, 1, 10)), (dt.date(2000, 1, 11), dt.date(2000, 1, 20)), (dt.date(2000, 1, 21), dt.date(2000, 1, 25))]
    assert io.date_chunks(dt.date(2000, 1, 1), None, 3600)[-1][1] == dt.date.today()
    assert list(io.batched(range(5), 2)) == [[0, 1], [2, 3], [4]]
    assert "CAST(s AS INT) <= 2000" in io.overlap_predicates(dt.date(2000, 1, 1), dt.date(2000, 5, 1), 3600, "s", "e")[0]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("TW_A", "x")
    p = tmp_path / "c.json"
    p.write_text('{"a": "${TW_A}/${TW_NONE}", "b": [1, "${TW_A}"]}')
    assert config.load_config(p) == {"a": "x/", "b": [1, "x"]}
    p.write_text("")
    assert config.load_config(p) == {}
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.json")
    same = {"a": ["$5", "${", "$TW_A", {"b": ["${TW_A}", 3, None]}]}
    assert config.expand(same) == {"a": ["$5", "${", "$TW_A", {"b": ["x", 3, None]}]} and same["a"][3]["b"][0] == "${TW_A}"


def test_checkpoint_without_settings(tmp_path):
    """A plain machine: no configuration folder, no spark.checkpoint.dir."""
    import subprocess
    import sys

    code = "from tidewheel.session import build_session, checkpoint; s = build_session('local[1]'); print(checkpoint(s.range(3)).count())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "3", out.stderr[-2000:]


def test_io(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.lit("a"))
    calls = []

    def build():
        calls.append(1)
        return df

    for force in (False, False, True):
        assert io.cached_stage(spark, str(tmp_path / "s"), build, force).count() == 5
    assert len(calls) == 2
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "id bigint, x string").count() == 5
    io.write_reports({"f1": df, "f2": df}, str(tmp_path / "r"))
    assert io.read_parquet(spark, str(tmp_path / "r"), ["id"], "factor = 'f1'").count() == 5
    with pytest.raises(FileNotFoundError):
        io.read_parquet(spark, str(tmp_path / "none"))


def test_returns(spark):
    rows = [("a", dt.date(2000 + i // 12, i % 12 + 1, 28), 0.01) for i in range(24)] + [("a", dt.date(2003, m, 28), 0.02) for m in range(1, 13)] + [("b", dt.date(2000, m, 28), 0.01) for m in range(1, 5)]
    a = etl.forward_returns(etl.annual_returns(spark.createDataFrame(rows, "k string, d date, r double"), "k", "d", "r"), "k")
    got = {(r["k"], r["year"]): r["forward_return"] for r in a.collect()}
    assert set(got) == {("a", 2000), ("a", 2001), ("a", 2003)} and got[("a", 2001)] == pytest.approx(1.02**12 - 1) and got[("a", 2003)] is None


def test_roles_overlaps_years(spark):
    df = spark.createDataFrame([("1", "Group CEO", "2000", "Curr"), ("1", "Division CEO", "2001", None), ("2", "Chief Executive", "x", "2004"), ("1", None, "1990", "1995")], "k string, role string, s string, e string")
    assert [r["role"] for r in etl.roles_of(df, df.where("k = '1'"), "k", "role", ["ceo"], ["division"]).collect()] == ["Group CEO"]
    assert df.where(etl.overlaps("s", "e", 1996, 2003)).count() == 2
    y = etl.explode_years(df, F.col("s").try_cast("int"), F.coalesce(F.col("e").try_cast("int"), F.lit(2001)))
    assert sorted(r["year"] for r in y.collect()) == [1990, 1991, 1992, 1993, 1994, 1995, 2000, 2001, 2001]
    assert etl.explode_years(df, F.lit(2003), F.lit(2001)).count() == 0


def test_streaming_returns(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", dt.datetime(2000, m, 1), 0.01) for m in range(1, 13)], "k string, ts timestamp, r double").write.parquet(src)
    q = streaming_annual_returns(spark.readStream.schema("k string, ts timestamp, r double").parquet(src), "k", "ts", "r").writeStream.outputMode("complete").format("memory").queryName("annual").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("annual").first()["annual_return"] == pytest.approx(1.01**12 - 1)
    assert time.time() and os.path.exists(src)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_members_and_linked_returns(spark):
    df = spark.createDataFrame([("i1", "a", 1), ("i1", "b", None), ("i2", "c", 3), (None, "d", 4)], "idx string, id string, v int")
    assert [tuple(r) for r in etl.members(df, "idx", "i1", {"id": "key", "v": "v"}, ["v"]).collect()] == [("a", 1)]
    assert etl.members(df, "idx", "i1", {"id": "key"}).count() == 2
    annual = spark.createDataFrame([(1, 2000, 0.1), (2, 2000, 0.2), (3, 2000, 0.3)], "permco int, year int, annual_return double")
    links = spark.createDataFrame([(1, "g1"), (1, "g1"), (2, "g1"), (2, "g2"), (None, "g9")], "permco int, gvkey string")
    linked = etl.linked_returns(annual, links, "permco", "gvkey")
    assert sorted((r["gvkey"], r["annual_return"]) for r in linked.collect()) == [("g1", 0.1), ("g1", 0.2), ("g2", 0.2)]
    panel = spark.createDataFrame([("d1", "g1", 2000), ("d2", "g2", 2001), ("d3", None, 2000)], "d string, gvkey string, year int")
    got = etl.merge_returns(panel, linked, "gvkey", "year")
    assert sorted((r["d"], r["annual_return"]) for r in got.where("annual_return is not null").collect()) == [("d1", 0.1), ("d1", 0.2)] and got.count() == 4

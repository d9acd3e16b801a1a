import math

import pytest
from pyspark.sql import functions as F

from tidewheel.functions.distributions import incomplete_beta, normal_two_sided, t_two_sided
from tidewheel.functions.ids import is_deleted, is_open_end, norm_id, text_date


def test_norm_id(spark):
    cases = {"123": "123", " 0123 ": "123", "\t123.0": "123", "1.5E1": "15", "1.000261E6": "1000261", "+7": "7", "123.00": "123", "9" * 40: "9" * 40}
    bad = ["", " ", "abc", "0", "-1", "12.5", "1.25E1", "NaN", "<NA>", "id?", "-", "N/A", None, "0.0", "1 2"]
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(b, None) for b in bad], "x string, want string")
    for r in df.select("x", "want", norm_id("x").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_text_date(spark):
    cases = {"2001-02-03": ("2001-02-03", "2001-02-03"), "2001-02-03 00:00:00": ("2001-02-03", "2001-02-03"), "03 Feb 2001": ("2001-02-03", "2001-02-03"), "20010203": ("2001-02-03", "2001-02-03"), "2001/02/03": ("2001-02-03", "2001-02-03"), "2001": ("2001-01-01", "2001-12-31"), "2001.0": ("2001-01-01", "2001-12-31"), "2004-02": ("2004-02-01", "2004-02-29"), "Feb 2004": ("2004-02-01", "2004-02-29"), " 2001-2-3 ": ("2001-02-03", "2001-02-03")}
    bad = ["2001-02-30", "0000-00-00", "2001-13", "31 Foo 2009", "tbc", "??", "", None, "20010230", "31 Apr 2001", "2001-00-01"]
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()] + [(b, None, None) for b in bad], "x string, a string, b string")
    for r in df.select("*", text_date("x").cast("string").alias("s"), text_date("x", True).cast("string").alias("e")).collect():
        assert (r["s"], r["e"]) == (r["a"], r["b"]), r


def test_open_and_deleted(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", " ", "Curr", "C", "current", "9999-12-31", "9999", "2100-12-31", "tbc", "2001")], "x string")
    assert [r[0] for r in df.select(is_open_end("x")).collect()] == [True] * 8 + [False] * 3
    d = spark.createDataFrame([(x,) for x in ("D", " del", "DELETED", "a", None, "")], "x string")
    assert [r[0] for r in d.select(is_deleted("x")).collect()] == [True] * 3 + [False] * 3


def test_distributions():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert t_two_sided(None, 3) is None and math.isclose(t_two_sided(0.0, 5), 1.0)


def test_average_rank_ignores_nulls(spark):
    from tidewheel.functions.stats import average_rank, percent_rank

    df = spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (1, 5.0), (2, None)], "d int, x double")
    got = sorted(((r["d"], r["x"], r["k"], r["p"]) for r in df.select("d", "x", average_rank("x", ["d"], None).alias("k"), percent_rank("x", ["d"]).alias("p")).collect()), key=str)
    assert got == sorted([(1, 2.0, 1.5, 0.5), (1, 2.0, 1.5, 0.5), (1, 5.0, 3.0, 1.0), (1, None, None, None), (2, None, None, None)], key=str)
    assert df.select(F.lit(1)).count() == 5

"""The forms for huge dates give what the windows give."""

import random

import pytest

from tidewheel.operators import features, huge_groups


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(i, rng.choice(["d1", "d1", "d1", "d2", "d3", None]), rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.0, -0.0, 1.0, 1.0, rng.gauss(0, 50), rng.gauss(0, 1e-9)]), rng.choice([None, 0.0, -5.0, rng.random() * 99])) for i in range(900)] + [(1000, "one", "a", 3.0, 1.0), (1001, "none", "a", None, 1.0)]
    return spark.createDataFrame(data, "id int, d string, g string, x double, cap double").cache()


CASES = {
    "winsorize": lambda m, f, kw: m.winsorize(f, "x", "o", ["d"], 0.05, 0.9, **kw),
    "zscore": lambda m, f, kw: m.zscore(f, "x", "o", ["d"]),
    "group": lambda m, f, kw: m.group_neutralize(f, "x", "o", ["d", "g"]),
    "size": lambda m, f, kw: m.size_neutralize(f, "x", "cap", "o", ["d"]),
    "rank": lambda m, f, kw: m.rank_feature(f, "x", "o", ["d"]),
    "buckets": lambda m, f, kw: m.quantile_buckets(f, "x", "o", ["d"], 4, **kw),
}


@pytest.mark.parametrize("name", CASES)
def test_same_as_windows(rows, name):
    want = {r["id"]: r["o"] for r in CASES[name](features, rows, {}).collect()}
    got = {r["id"]: r["o"] for r in CASES[name](huge_groups, rows, {"least": 200} if name in ("winsorize", "buckets") else {}).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9)), (k, v, got[k])


def test_large_dates_take_the_other_way(rows, monkeypatch):
    """Above WINDOW_ROWS there is no window over the date, and the pipeline gives the same."""
    from pyspark.sql import functions as F

    from tidewheel.operators import research

    data = rows.withColumn("e", F.col("id") % 50).withColumn("y", F.col("x") * F.col("x"))
    run = lambda: features.feature_pipeline(data, ["x"], "d", "e", "g", "cap", ("x",), ("id",))
    want = {r["id"]: r for r in run().collect()}
    ric = {r["d"]: r["ic"] for r in research.rank_ic(data, "x", "y", "d").collect()}
    monkeypatch.setattr(features, "WINDOW_ROWS", 100)
    windows = [line for line in run()._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "windowspec" in line]
    assert not [line for line in windows if "[d#" in line.split("windowspec")[-1].split("], [")[-2]], windows
    got = {r["id"]: r for r in run().collect()}
    for k, r in want.items():
        for c in ("x_w", "x_z", "x_ind_neutral", "x_cap_neutral", "x_lagged", "x_rank"):
            assert got[k][c] == (r[c] if r[c] is None else pytest.approx(r[c], abs=1e-9)), (k, c)
    assert {r["d"]: r["ic"] for r in research.rank_ic(data, "x", "y", "d").collect()} == pytest.approx(ric)
    glob = {r["id"]: r["o"] for r in features.winsorize(rows, "x", "o", None, 0.1, 0.8).collect()}
    monkeypatch.undo()
    assert glob == pytest.approx({r["id"]: r["o"] for r in features.winsorize(rows, "x", "o", None, 0.1, 0.8).collect()})


def test_sorted_groups(rows):
    from tidewheel.operators import portfolio

    for groups in (1, 3, 10, 2000):
        got, want = ({(r["id"], r["side"]) for r in portfolio.sorted_groups(rows, "x", ["d"], groups, ["id"], large).collect()} for large in (True, False))
        assert got == want and want
    assert portfolio.sorted_groups(rows, "x", ["d"], 3, ["id"], True).columns == [*rows.columns, "side"]
    assert portfolio.sorted_groups(rows.limit(0), "x", ["d"], 3, ["id"], True).count() == 0


def test_empty(rows):
    for f in CASES.values():
        assert f(huge_groups, rows.limit(0), {}).count() == 0

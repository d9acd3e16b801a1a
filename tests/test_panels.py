"""Features, research, econometrics and portfolios against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import econometrics, features, portfolio, research


def test_winsorize_global(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 1000)], "x double")
    got = sorted(r[0] for r in features.winsorize(df, "x", "w", None, 0.1, 0.9).select("w").collect())
    lo, hi = np.quantile([1, 2, 3, 4, 5, 1000], [0.1, 0.9])
    assert got == pytest.approx(sorted(np.clip([1, 2, 3, 4, 5, 1000], lo, hi)))


def test_zscore_constant_is_null(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "x double")
    assert {r["z"] for r in features.zscore(df, "x", "z").collect()} == {None}


def test_cross_sections_match_pandas(panel):
    p = features.zscore(panel, "factor", "z", ["date"])
    p = features.group_neutralize(p, "z", "n", ["date", "industry"])
    p = features.size_neutralize(p, "z", "cap", "s", ["date"])
    p = features.rank_feature(p, "s", "r", ["date"])
    p = features.lag_feature(p, "r", "l", "entity", ["date"])
    p = features.quantile_buckets(p, "factor", "b", ["date"], 5)
    d = p.toPandas().sort_values(["entity", "date"]).reset_index(drop=True)
    g = d.groupby("date")
    same = lambda a, b: np.allclose(a.astype(float), b.astype(float), atol=1e-9, equal_nan=True)
    z = g["factor"].transform(lambda x: (x - x.mean()) / (x.std(ddof=0) if x.std(ddof=0) > 0 else np.nan))
    assert same(d["z"], z) and z.isna().sum() > 10
    assert same(d["n"], z - z.groupby([d["date"], d["industry"]]).transform("mean"))
    res = pd.Series(index=d.index, dtype=float)
    for _, i in g.groups.items():
        i = [k for k in i if z[k] == z[k] and d.loc[k, "cap"] == d.loc[k, "cap"]]
        if len(i) >= 2:
            x = np.column_stack([np.ones(len(i)), np.log(np.maximum(d.loc[i, "cap"], 1e-9))])
            res[i] = z[i] - x @ np.linalg.lstsq(x, z[i], rcond=None)[0]
    assert same(d["s"], res)
    rank = d["s"].groupby(d["date"]).rank(pct=True)
    assert same(d["r"], rank)
    assert same(d["l"], rank.groupby(d["entity"]).shift(1))
    want = g["factor"].transform(lambda x: pd.qcut(x, 5, labels=False, duplicates="drop") + 1 if x.nunique() > 1 else np.nan)
    assert same(d["b"], want)


def test_buckets_with_ties_and_nulls(spark):
    rows = [(1, float(x)) for x in (1, 1, 1, 1, 2, 3)] + [(1, None), (2, 4.0), (2, 4.0), (3, None)]
    df = spark.createDataFrame(rows, "d int, x double")
    got = features.quantile_buckets(df, "x", "b", ["d"], 4).toPandas()
    one = got[(got.d == 1) & got.x.notna()].sort_values("x")
    assert list(one["b"]) == list(pd.qcut(one["x"], 4, labels=False, duplicates="drop") + 1)
    assert got[(got.d > 1) | got.x.isna()]["b"].isna().all()


def test_validate(spark):
    df = spark.createDataFrame([(None,)] * 90 + [(1.0,)] * 10, "x double")
    r = features.validate_feature(df, "x").first()
    assert not r["passed"] and r["null_share"] == 0.9
    assert not features.validate_feature(df.limit(0), "x").first()["passed"]


def test_pca_matches_numpy(panel):
    df = panel.withColumn("a", F.col("factor") * 2 + F.col("ret"))
    out, load = features.pca_composites(df, ["factor", "ret", "a"], 2, "date")
    d = out.toPandas()
    z = np.column_stack([d.groupby("date")[c].transform(lambda x: (x - x.mean()) / (x.std(ddof=0) or np.nan)) for c in ("factor", "ret", "a")])
    whole = ~np.isnan(z).any(axis=1)
    z = z[whole]
    values, vectors = np.linalg.eigh(np.cov((z - z.mean(0)).T))
    v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    assert np.allclose(d["pc1"][whole], (z - z.mean(0)) @ v, atol=1e-8) and d["pc1"][~whole].isna().all()
    assert load.orderBy("component").first()["explained_variance_ratio"] == pytest.approx(values[-1] / values.sum())
    with pytest.raises(ValueError):
        features.pca_composites(df.limit(0), ["factor", "ret"], 2, "date")


def test_research(panel):
    ic = research.rank_ic(panel, "factor", "ret", "date").toPandas().set_index("date")["ic"].sort_index()
    d = panel.toPandas()
    want = {}
    for date, g in d.groupby("date"):
        g = g.dropna(subset=["factor", "ret"])
        want[date] = g["factor"].rank().corr(g["ret"].rank()) if len(g) >= 3 else np.nan
    assert np.allclose(ic.astype(float), pd.Series(want).sort_index(), equal_nan=True) and ic.isna().any()
    s = research.ic_summary(research.rank_ic(panel, "factor", "ret", "date")).first()
    assert s["mean_ic"] > 0 and s["n"] == pd.Series(want).notna().sum()
    q = research.quantile_returns(panel, "factor", "ret", "date")
    ls = research.long_short(q, "date")
    assert ls.agg(F.avg("ret")).first()[0] > 0
    perf = research.performance_stats(ls, "date").first()
    r = ls.orderBy("date").toPandas()["ret"].dropna().to_numpy()
    grow = np.cumprod(1 + r)
    assert perf["max_drawdown"] == pytest.approx((grow / np.maximum.accumulate(grow) - 1).min())
    assert perf["cumulative_return"] == pytest.approx(grow[-1] - 1)
    assert research.performance_stats(ls.limit(0), "date").count() == 0
    decay = research.factor_decay(panel, "factor", "ret", "date", "entity", 3).orderBy("horizon").collect()
    assert [x["horizon"] for x in decay] == [1, 2, 3] and decay[0]["mean_ic"] == pytest.approx(s["mean_ic"])


def test_constant_side_gives_null(spark):
    df = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)] + [(2, None, None)], "d int, x double, y double")
    assert {r["d"]: r["ic"] for r in research.information_coefficient(df, "x", "y", "d").collect()} == {1: None, 2: None}


def test_regressions_match_numpy(panel):
    df = panel.withColumn("c", F.when(F.col("cap") > 0, F.log("cap")))
    out = econometrics.cross_sectional_regression(df, "ret", ["factor", "c"], "date").toPandas().set_index("date").sort_index()
    d = df.toPandas()
    coefs = []
    for date, g in sorted(d.groupby("date")):
        g = g.dropna(subset=["ret", "factor", "c"])
        if len(g) < 4:
            assert date not in out.index
            continue
        x = np.column_stack([np.ones(len(g)), g["factor"], g["c"]])
        b, rss, *_ = np.linalg.lstsq(x, g["ret"], rcond=None)
        se = np.sqrt(rss[0] / (len(g) - 3) * np.diag(np.linalg.inv(x.T @ x)))
        assert out.loc[date, ["coef_const", "coef_factor", "coef_c"]].to_numpy(float) == pytest.approx(b, abs=1e-9)
        assert out.loc[date, ["tstat_const", "tstat_factor", "tstat_c"]].to_numpy(float) == pytest.approx(b / se, rel=1e-6)
        coefs.append(b[1])
    fm = {r["variable"]: r for r in econometrics.fama_macbeth(df, "ret", ["factor", "c"], "date").collect()}
    u = np.array(coefs) - np.mean(coefs)
    s = u @ u + 2 * sum((1 - j / 4) * (u[j:] @ u[:-j]) for j in (1, 2, 3))
    assert fm["factor"]["mean"] == pytest.approx(np.mean(coefs)) and fm["factor"]["se"] == pytest.approx(np.sqrt(s) / len(u))
    assert 0 <= fm["factor"]["pvalue"] <= 1
    dates, whole = sorted(d["date"].unique()), d.dropna(subset=["ret", "factor"])
    early = whole["date"] < dates[int(len(dates) * 0.7)]
    oos = econometrics.out_of_sample(panel, "ret", ["factor"], "date").first()
    assert oos["n_train"] == early.sum() and oos["n_test"] == (~early).sum() and oos["oos_r2"] < 1
    sub = econometrics.subsample_analysis(panel, "ret", ["factor"], "date", "industry")
    assert sub.count() == 6
    rob = econometrics.robustness_test(panel, "ret", ["factor"], "date", [[], ["cap"]]).collect()
    assert [(r["spec"], r["controls"], r["variable"]) for r in sorted(rob)] == [(0, "none", "factor"), (1, "cap", "factor")]
    assert econometrics.fama_macbeth(panel.limit(0), "ret", ["factor"], "date").count() == 0


def test_constant_regressor(spark):
    df = spark.createDataFrame([(1, float(i), 2.0) for i in range(6)], "d int, y double, x double")
    r = econometrics.cross_sectional_regression(df, "y", ["x"], "d").first()
    assert r["coef_const"] is None and r["coef_x"] == pytest.approx(1.25)


def test_significance():
    assert econometrics.significance_test(0.05, 0.01, 100)["significant"]
    assert not econometrics.significance_test(0.001, 0.05, 100)["significant"]
    assert not econometrics.significance_test(0.1, 0.0, 100)["significant"]


def test_portfolio_matches_pandas(panel):
    held = panel.where("cap > 0")
    w = portfolio.weight_table(portfolio.value_weights(held, "date", "cap"), "date", "entity")
    d = held.toPandas()
    m = (d.set_index(["date", "entity"])["cap"] / d.groupby("date")["cap"].transform("sum").to_numpy()).unstack().fillna(0.0)
    assert np.allclose(m.sum(axis=1), 1)
    t = portfolio.turnover(w, "date", "entity").toPandas().set_index("date")["turnover"].sort_index()
    assert np.allclose(t, 0.5 * m.diff().abs().sum(axis=1))
    a = portfolio.attribution(w, held, "date", "entity").toPandas().set_index("date")["total_return"].sort_index()
    assert np.allclose(a, (m.shift(1) * d.pivot(index="date", columns="entity", values="ret")).sum(axis=1))
    risk = portfolio.risk_metrics(portfolio.attribution(w, held, "date", "entity").withColumnRenamed("total_return", "ret")).first()
    assert risk["var"] == pytest.approx(np.quantile(a, 0.05))
    assert portfolio.average_holdings(w, "date").first()[0] == pytest.approx((m > 0).sum(axis=1).mean())
    assert portfolio.equal_weights(panel, "date", "entity").groupBy("date").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").count() == 0

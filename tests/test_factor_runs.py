"""Runs over several factors give what each factor gives alone, and what pandas gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import econometrics, factor_runs, features, portfolio, research
from tidewheel.sources import io


@pytest.fixture(scope="module")
def wide(panel):
    p = features.rank_feature(panel, "factor", "a_rank", ["date"])
    p = p.withColumn("noise", F.xxhash64("entity", "date") % 1000)
    p = features.rank_feature(p, "noise", "pc1_rank", ["date"])
    return features.rank_feature(p.withColumn("x", F.col("cap") + F.col("noise")), "x", "b_active_rank", ["date"]).withColumn("b_rank_note", F.lit("no factor")).cache()


FACTORS = ["a_rank", "b_active_rank", "pc1_rank"]


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(a, b):
    return a == b or a is not None and b is not None and (a == pytest.approx(b, abs=1e-9))


def test_names(spark, wide):
    assert factor_runs.discovered(wide) == FACTORS
    assert factor_runs.report_name("decay", "n_unique_connected_rank") == "decay" and factor_runs.report_name("decay", "a_rank") == "a_rank_decay"
    kinds = spark.createDataFrame([("pc1_rank",), ("n_unique_connected_rank",), ("b_active_rank",), ("a_rank",)], "f string").select(factor_runs.category("f"))
    assert [r[0] for r in kinds.collect()] == ["PCA composite", "Connection count", "Active", "Cumulative"]


def test_research_run(wide, spark, tmp_path):
    out = factor_runs.research_run(wide, FACTORS, "ret", "date", "entity")
    compared = rows(out["comparison"], "factor")
    assert set(compared) == {(f,) for f in FACTORS}
    for f in FACTORS:
        ic = research.ic_summary(research.information_coefficient(wide, f, "ret", "date")).first()
        rank = research.ic_summary(research.rank_ic(wide, f, "ret", "date")).first()
        spread = research.long_short(research.quantile_returns(wide, f, "ret", "date"), "date", 5, 1)
        perf = research.performance_stats(spread, "date", periods=1).first()
        r = compared[(f,)]
        for got, want in ((r["mean_ic"], ic["mean_ic"]), (r["mean_rank_ic"], rank["mean_ic"]), (r["rank_icir"], rank["icir"]), (r["long_short_sharpe"], perf["sharpe"]), (r["long_short_max_drawdown"], perf["max_drawdown"])):
            assert same(got, want), f
        decay = rows(out["factor_decay"].where(F.col("factor") == f), "horizon")
        for h, x in rows(research.factor_decay(wide, f, "ret", "date", "entity", 4), "horizon").items():
            assert same(decay[h]["mean_ic"], x["mean_ic"]) and decay[h]["n"] == x["n"]
    assert {r["label"] for r in out["quantile_returns"].collect()} <= {f"Q{i}" for i in range(1, 6)}
    for name, df in out.items():
        df.write.parquet(str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "ic_timeseries")).count() == 3 * wide.select("date").distinct().count()


def test_econometrics_run(wide):
    out = factor_runs.econometrics_run(wide, FACTORS, "ret", "date", ["cap", "absent"])
    compared = rows(out["comparison"], "factor")
    for f in FACTORS:
        fm = rows(econometrics.fama_macbeth(wide, "ret", [f], "date"), "variable")[(f,)]
        oos = econometrics.out_of_sample(wide, "ret", [f], "date").first()
        r = compared[(f,)]
        assert same(r["mean_coef"], fm["mean"]) and same(r["t_stat"], fm["tstat"]) and same(r["p_value"], fm["pvalue"]) and same(r["oos_r2"], oos["oos_r2"])
    assert {(r["factor"], r["controls"]) for r in out["robustness"].collect()} == {(f, c) for f in FACTORS for c in ("none", "cap")}
    assert {r["variable"] for r in out["multivariate"].collect()} == {"const", *FACTORS}
    scape = factor_runs.landscape(factor_runs.research_run(wide, FACTORS, "ret", "date", "entity")["comparison"], out["comparison"]).collect()
    assert [r["long_short_sharpe"] for r in scape] == sorted((r["long_short_sharpe"] for r in scape), reverse=True) and {r["significant"] for r in scape} <= {True, False, None}


def test_long_only_run_matches_pandas(wide):
    out = factor_runs.long_only_run(wide, FACTORS, "ret", "date", "entity")
    compared = rows(out["comparison"], "factor")
    d = wide.toPandas()
    for f in FACTORS:
        top = d[d[f] > 0.8]
        w = (top.assign(w=1 / top.groupby("date")["entity"].transform("count")).pivot_table(index="date", columns="entity", values="w")).fillna(0.0)
        r = top.pivot_table(index="date", columns="entity", values="ret", dropna=False).reindex(w.index)
        total = (w.shift(1) * r.reindex(columns=w.columns)).sum(axis=1)
        turn = 0.5 * w.diff().abs().sum(axis=1)
        got = compared[(f,)]
        assert got["avg_turnover"] == pytest.approx(turn.mean()) and got["avg_holdings"] == pytest.approx((w > 0).sum(axis=1).mean())
        assert got["ann_return"] == pytest.approx(total.mean()) and got["var"] == pytest.approx(np.quantile(total, 0.05))
        series = pd.Series({x["date"]: x["total_return"] for x in out["attribution"].where(F.col("factor") == f).collect()}).sort_index()
        assert np.allclose(series, total)
    by_cap = factor_runs.long_only_run(wide.where("cap > 0"), FACTORS[:1], "ret", "date", "entity", "cap")["weights"]
    assert by_cap.groupBy("date").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    spreads = factor_runs.research_run(wide, FACTORS, "ret", "date", "entity")["comparison"]
    table = factor_runs.books_against_spreads(spreads, out["comparison"]).collect()
    assert {r["factor"] for r in table} == set(FACTORS) and all(same(r["long_only_sharpe"], compared[(r["factor"],)]["sharpe"]) for r in table)


def test_turnover_of_groups(spark):
    w = spark.createDataFrame([("f", 1, "a", 1.0), ("f", 2, "b", 1.0), ("g", 1, "a", 1.0), ("g", 3, "a", 0.5), ("g", 3, "b", 0.5)], "factor string, date int, entity string, weight double")
    got = {(r["factor"], r["date"]): r["turnover"] for r in portfolio.turnover(w, "date", "entity", by=["factor"]).collect()}
    assert got == {("f", 1): 0.0, ("f", 2): 1.0, ("g", 1): 0.0, ("g", 3): 0.5}


def test_pca_run(wide):
    df = wide.withColumnRenamed("factor", "a_lagged").withColumnRenamed("ret", "b_lagged")
    out, loadings, reports = factor_runs.pca_run(df, "date", 2)
    assert {"pc1", "pc2", "pc1_rank", "pc2_rank"} <= set(out.columns) and loadings.count() == 2
    assert {r["feature"] for r in reports.collect()} == {"pc1_rank", "pc2_rank"} and all(r["passed"] for r in reports.collect())


def test_kernel_density(panel):
    x = np.array([r[0] for r in panel.where("factor is not null and not isnan(factor)").select("factor").collect()])
    got = research.kernel_density(panel, "factor", 50).orderBy("x").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid) and np.allclose(got["density"], want)
    assert research.kernel_density(panel.limit(0), "factor").count() == 0 and research.histogram(panel.limit(0), "factor").count() == 0
    bins = research.histogram(panel, "factor", 40).toPandas()
    assert len(bins) == 40 and bins["n"].sum() == len(x) and (bins.sort_values("bin")["n"] == np.histogram(x, 40)[0]).mean() > 0.9


def test_chunked_stage(spark, tmp_path):
    built = []

    def build(chunk):
        built.append(chunk)
        return spark.range(chunk[1]).withColumn("y", F.lit(chunk[0]))

    chunks = {"1990-a": (1990, 3), "1991-a": (1991, 4)}
    path = str(tmp_path / "stage")
    assert io.chunked_stage(spark, path, chunks, build).count() == 7 and len(built) == 2
    assert io.chunked_stage(spark, path, chunks | {"1992-a": (1992, 5)}, build).count() == 12 and built[2:] == [(1992, 5)]
    assert io.chunked_stage(spark, path, {"1990-a": (1990, 3)}, build).count() == 3 and len(built) == 3

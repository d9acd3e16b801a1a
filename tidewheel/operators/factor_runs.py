"""Whole runs over every factor of a panel: research, regressions and long-only books, each as one job over all factors.

The factors of a wide panel are stacked to (factor, date, entity, value), and every report is grouped by factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import econometrics, features, portfolio, research

#: The factor whose reports go by their plain names, and the labels of the kinds of factors.
PRIMARY = "n_unique_connected_rank"
COMPOSITE, COUNT, ACTIVE, CUMULATIVE = "PCA composite", "Connection count", "Active", "Cumulative"


def discovered(df: DataFrame, suffix: str = "_rank") -> list[str]:
    """Columns that end with `suffix`, sorted."""
    return sorted(c for c in df.columns if c.endswith(suffix))


def report_name(report: str, factor: str, primary: str = PRIMARY) -> str:
    """Name of a factor's report: the plain name for the primary factor, the factor's before it for the others."""
    return "_".join([*([factor] if factor != primary else []), report])


def category(name: str, primary: str = PRIMARY) -> Column:
    """Kind of the factor named in a column: composites begin with pc, counts are the primary factor, active ones say so."""
    n = F.col(name)
    kinds = {COMPOSITE: n.startswith("pc"), COUNT: n.eqNullSafe(F.lit(primary)), ACTIVE: n.contains("_active_")}
    return F.coalesce(*[F.when(fits, F.lit(kind)) for kind, fits in kinds.items()], F.lit(CUMULATIVE))


def stacked(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """factor, keep, value: a row per row of `df` and factor."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in factors])))


def research_run(df: DataFrame, factors: list[str], ret: str, date: str, entity: str, periods: int = 1, n: int = 5, long: int = 5, short: int = 1, horizons: int = 4, window: int = 3, order: tuple[str, ...] = (), large: bool | None = None) -> dict[str, DataFrame]:
    """ic_timeseries, factor_decay, quantile_returns, long_short_returns, rolling_sharpe (each with factor) and comparison.

    comparison: factor, mean_ic, mean_rank_ic, rank_icir, long_short_sharpe, long_short_ann_return, long_short_max_drawdown.
    """
    by = ["factor"]
    # with all factors in a table, a group is still a date of one factor
    large = features.is_large(df, [date], large)
    rows = stacked(df, factors, [date, entity, ret, *[c for c in order if c not in (date, entity, ret)]])
    ic = research.information_coefficient(rows, "value", ret, date, by)
    ric = research.rank_ic(rows, "value", ret, date, by, large)
    series = ic.join(ric.withColumnRenamed("ic", "rank_ic"), [*by, date], "left")
    quantiles = research.quantile_returns(rows, "value", ret, date, n, by=by, large=large)
    spread = research.long_short(quantiles, date, long, short, by)
    stats = research.performance_stats(spread, date, periods=periods, by=by)
    mean_ic = research.ic_summary(ic, by).select(*by, "mean_ic")
    mean_rank = research.ic_summary(ric, by).select(*by, F.col("mean_ic").alias("mean_rank_ic"), F.col("icir").alias("rank_icir"))
    perf = stats.select(*by, F.col("sharpe").alias("long_short_sharpe"), F.col("ann_return").alias("long_short_ann_return"), F.col("max_drawdown").alias("long_short_max_drawdown"))
    return {
        "ic_timeseries": series,
        "factor_decay": research.factor_decay(rows, "value", ret, date, entity, horizons, order, by, large=large),
        "quantile_returns": quantiles.withColumn("label", F.concat(F.lit("Q"), F.col("bucket").cast("string"))),
        "long_short_returns": spread,
        "rolling_sharpe": research.rolling_sharpe(spread, date, window, periods, by=by),
        "comparison": mean_ic.join(mean_rank, by, "left").join(perf, by, "left"),
    }


def econometrics_run(df: DataFrame, factors: list[str], ret: str, date: str, controls: list[str], lags: int = 3, train_share: float = 0.7) -> dict[str, DataFrame]:
    """fama_macbeth, robustness (without and with those controls that exist), multivariate (all factors at once) and comparison.

    comparison: factor, oos_r2, mean_coef, t_stat, p_value.
    """
    by, there = ["factor"], [c for c in controls if c in df.columns]
    rows = stacked(df, factors, [date, ret, *there])
    fm = econometrics.fama_macbeth(rows, ret, ["value"], date, lags, by)
    oos = econometrics.out_of_sample(rows, ret, ["value"], date, train_share, by)
    mine = fm.where("variable = 'value'").select(*by, F.col("mean").alias("mean_coef"), F.col("tstat").alias("t_stat"), F.col("pvalue").alias("p_value"))
    names = df.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    return {
        "fama_macbeth": fm,
        "robustness": econometrics.robustness_test(rows, ret, ["value"], date, [[], there], by),
        "multivariate": econometrics.fama_macbeth(df, ret, factors, date, lags),
        "comparison": names.join(oos.select(*by, "oos_r2"), by, "left").join(mine, by, "left"),
    }


def long_only_run(df: DataFrame, factors: list[str], ret: str, date: str, entity: str, cap: str | None = None, periods: int = 1, n: int = 5, long: int = 5) -> dict[str, DataFrame]:
    """weights, turnover, attribution (each with factor) and comparison of the books of the highest ranks of each factor.

    Weights are equal, or by `cap` where one is named. comparison: factor, avg_turnover, avg_holdings, and the columns of
    performance_stats and risk_metrics; factors without rows above the limit don't come out.
    """
    by = ["factor"]
    rows = stacked(df, factors, [date, entity, ret, *([cap] if cap else [])])
    top = portfolio.long_only_book(rows, "value", n, long)
    held = portfolio.value_weights(top, date, cap, by=by) if cap else portfolio.equal_weights(top, date, entity, by=by)
    weights = portfolio.weight_table(held, date, entity, by=by)
    # an entity with several rows at a date has the mean of their returns
    returns = top.groupBy(*by, date, entity).agg(F.avg(F.when(~F.isnan(ret), F.col(ret))).alias("ret"))
    turnover = portfolio.turnover(weights, date, entity, by=by)
    series = portfolio.attribution(weights, returns, date, entity, by=by)
    plain = series.withColumnRenamed("total_return", "ret")
    risk = portfolio.risk_metrics(plain, periods=periods, by=by).drop("n", "ann_vol")
    report = turnover.groupBy(*by).agg(F.avg("turnover").alias("avg_turnover")).join(portfolio.average_holdings(weights, date, by), by)
    return {"weights": weights, "turnover": turnover, "attribution": series, "comparison": report.join(research.performance_stats(plain, date, periods=periods, by=by), by).join(risk, by)}


def landscape(comparison: DataFrame, regressions: DataFrame) -> DataFrame:
    """Both comparisons joined on factor, with the category and a flag for p < 0.05; best long-short Sharpe first."""
    out = comparison.join(regressions, "factor", "left")
    return out.select("*", category("factor").alias("category"), (F.col("p_value") < 0.05).alias("significant")).orderBy(F.col("long_short_sharpe").desc_nulls_last(), "factor")


def books_against_spreads(comparison: DataFrame, books: DataFrame) -> DataFrame:
    """factor, long_short_sharpe, long_only_sharpe, avg_turnover, max_drawdown; best long-short Sharpe first."""
    own = books.select("factor", F.col("sharpe").alias("long_only_sharpe"), "avg_turnover", "max_drawdown")
    return comparison.select("factor", "long_short_sharpe").join(own, "factor", "left").orderBy(F.col("long_short_sharpe").desc_nulls_last(), "factor")


def pca_run(df: DataFrame, date: str, n: int = 3, suffix: str = "_lagged", max_null_share: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(df with pcN and pcN_rank, loadings, reports of the ranks) from the columns that end with `suffix`."""
    from functools import reduce

    out, loadings = features.pca_composites(df, discovered(df, suffix), n, date)
    names = [f"pc{i}" for i in range(1, n + 1)]
    for c in names:
        out = features.rank_feature(out, c, f"{c}_rank", [date])
    reports = [features.validate_feature(out, f"{c}_rank", max_null_share) for c in names]
    return out, loadings, reduce(DataFrame.unionByName, reports)

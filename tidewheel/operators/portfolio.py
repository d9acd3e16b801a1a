"""Portfolio construction on long tables (date, entity, weight); entity-wide matrices are never pivoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.stats import clean
from tidewheel.operators import huge_groups
from tidewheel.operators.features import is_large


def month_end_dates(df: DataFrame, date: str) -> DataFrame:
    """month, rebalance_date: the last date that occurs in each calendar month."""
    return df.where(F.col(date).isNotNull()).groupBy(F.date_trunc("month", date).cast("date").alias("month")).agg(F.max(date).alias("rebalance_date"))


def _with_sums(df: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """`df` with `__s`, the total of the row's keys (dates and report groups, so few rows to join); null keys are keys."""
    sums = F.broadcast(df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(total.alias("__s")))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(sums, on, "left").drop(*[f"__k_{k}" for k in keys])


def equal_weights(df: DataFrame, date: str, entity: str, out: str = "weight", by: list[str] | None = None) -> DataFrame:
    """1 / number of rows of the date whose entity is known."""
    return _with_sums(df, [*(by or []), date], F.count(entity)).withColumn(out, F.try_divide(F.lit(1.0), F.col("__s"))).drop("__s")


def value_weights(df: DataFrame, date: str, cap: str, out: str = "weight", by: list[str] | None = None) -> DataFrame:
    """cap / sum of caps of the date; null caps get null."""
    c = clean(cap)
    return _with_sums(df, [*(by or []), date], F.sum(c)).withColumn(out, F.try_divide(c, F.col("__s"))).drop("__s")


def weight_table(df: DataFrame, date: str, entity: str, weight: str = "weight", by: list[str] | None = None) -> DataFrame:
    """(by,) date, entity, weight: the mean of repeated rows; what is missing counts as 0 elsewhere."""
    return df.where(F.col(date).isNotNull() & F.col(entity).isNotNull() & F.col(weight).isNotNull()).groupBy(*(by or []), date, entity).agg(F.avg(weight).alias("weight"))


def _next_dates(weights: DataFrame, date: str, by: list[str]) -> DataFrame:
    """by, date, __next, __first: the next and the first date of the table; one row per date and report group."""
    w = Window.partitionBy(*by).orderBy(date)
    return weights.select(*by, date).distinct().withColumns({"__next": F.lead(date).over(w), "__first": F.min(date).over(w)})


def _changes(weights: DataFrame, date: str, entity: str, by: list[str]) -> DataFrame:
    """by, date, entity, change: each entity's weight less that at the table's date before; the first date is left out.

    Every weight enters at its date and leaves at the next one, so one aggregation replaces the dense matrix.
    """
    w = weights.join(F.broadcast(_next_dates(weights, date, by)), [*by, date])
    move = lambda at, weight: F.struct(at.alias("__d"), weight.alias("__w"))
    moves = w.select(*by, F.col(entity).alias("__e"), "__first", F.inline(F.array(move(F.col(date), F.col("weight")), move(F.col("__next"), -F.col("weight"))))).where("__d > __first")
    return moves.groupBy(*by, "__d", "__e").agg(F.sum("__w").alias("change")).select(*by, F.col("__d").alias(date), F.col("__e").alias(entity), "change")


def turnover(weights: DataFrame, date: str, entity: str, factor: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(by,) date, turnover: factor x sum of absolute weight changes; 0 at the first date."""
    keys = [*(by or []), date]
    t = _changes(weights, date, entity, by or []).groupBy(*keys).agg((F.sum(F.abs("change")) * factor).alias("turnover"))
    return weights.select(*keys).distinct().join(t, keys, "left").select(*keys, F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def transaction_costs(weights: DataFrame, date: str, entity: str, cost_bps: float = 10.0, by: list[str] | None = None) -> DataFrame:
    """(by,) date, turnover (both sides, not halved), cost."""
    return turnover(weights, date, entity, 1.0, by).withColumn("cost", F.col("turnover") * cost_bps / 1e4)


def contributions(weights: DataFrame, returns: DataFrame, date: str, entity: str, ret: str = "ret", by: list[str] | None = None) -> DataFrame:
    """(by,) date, entity, contribution: weight at the weight table's date before, times the return."""
    keys = by or []
    held = weights.join(F.broadcast(_next_dates(weights, date, keys)), [*keys, date]).where("__next is not null").select(*keys, F.col("__next").alias(date), entity, "weight")
    return held.join(returns.select(*keys, date, entity, clean(ret).alias("__r")), [*keys, date, entity]).select(*keys, date, entity, (F.col("weight") * F.col("__r")).alias("contribution"))


def attribution(weights: DataFrame, returns: DataFrame, date: str, entity: str, ret: str = "ret", by: list[str] | None = None) -> DataFrame:
    """(by,) date, total_return: sum of contributions; 0 at dates without any (so at the first)."""
    keys = [*(by or []), date]
    total = contributions(weights, returns, date, entity, ret, by).groupBy(*keys).agg(F.sum("contribution").alias("total_return"))
    dates = weights.select(*keys).union(returns.select(*keys)).distinct()
    return dates.join(total, keys, "left").select(*keys, F.coalesce("total_return", F.lit(0.0)).alias("total_return"))


def top_contributors(contribution: DataFrame, entity: str, n: int = 10, digits: int | None = None) -> DataFrame:
    """The n entities of greatest mean contribution (rounded to `digits` before they are ordered); ties by entity."""
    mean = F.avg("contribution") if digits is None else F.round(F.avg("contribution"), digits) + F.lit(0.0)
    return contribution.where("contribution is not null").groupBy(entity).agg(mean.alias("mean_contribution")).orderBy(F.col("mean_contribution").desc(), entity).limit(n)


def risk_metrics(series: DataFrame, ret: str = "ret", periods: int = 12, level: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """ann_vol, downside_dev (population, of negatives, 0 without any), var (linear quantile), cvar (mean at or below it), n."""
    keys = by or []
    s = series.where(F.col(ret).isNotNull())
    w = s.withColumn("__var", F.percentile(F.col(ret), F.lit(level)).over(Window.partitionBy(*keys)))
    root = F.sqrt(F.lit(float(periods)))
    low = F.when(F.col(ret) < 0, F.col(ret))
    out = w.groupBy(*keys).agg((F.stddev_pop(ret) * root).alias("ann_vol"), F.coalesce(F.stddev_pop(low) * root, F.lit(0.0)).alias("downside_dev"), F.max("__var").alias("var"), F.avg(F.when(F.col(ret) <= F.col("__var"), F.col(ret))).alias("cvar"), F.count(ret).alias("n"))
    return out.where("n > 0")


def long_only_book(df: DataFrame, rank: str, n: int = 5, long: int = 5) -> DataFrame:
    """Rows whose percent rank lies above (long - 1) / n."""
    return df.where(F.col(rank) > (long - 1) / n)


def average_holdings(weights: DataFrame, date: str, by: list[str] | None = None) -> DataFrame:
    """One row (per group of `by`): mean number of entities with a positive weight per date."""
    keys = by or []
    return weights.groupBy(*keys, date).agg(F.count_if(F.col("weight") > 0).alias("k")).groupBy(*keys).agg(F.avg("k").alias("avg_holdings"))


def sorted_groups(df: DataFrame, factor: str, by: list[str], groups: int, order: list, large: bool | None = None) -> DataFrame:
    """`side` 'high' or 'low' for the max(1, n // groups) best and worst rows of each group; others are left out.

    `order` are the tie-breaking columns; nulls and NaN of the factor don't count. See features for `large`.
    """
    if is_large(df, by, large):
        return huge_groups.sorted_groups(df, factor, by, groups, order)
    d = df.where(clean(factor).isNotNull())
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*by)) / groups))
    hi = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(factor).desc(), *order))
    lo = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(factor).asc(), *order))
    d = d.withColumns({"__size": size, "__hi": hi, "__lo": lo})
    return d.withColumn("side", F.when(F.col("__hi") <= F.col("__size"), "high").when(F.col("__lo") <= F.col("__size"), "low")).where("side is not null").drop("__size", "__hi", "__lo")

"""Factor research: information coefficients, decay, quantile portfolios and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.stats import average_rank, clean, safe_corr, weighted_mean
from tidewheel.operators import huge_groups
from tidewheel.operators.features import is_large, quantile_buckets


def ranked_pairs(df: DataFrame, x: str, y: str, by: list[str], large: bool | None = None) -> DataFrame:
    """Complete pairs of `by` with average ranks __rx and __ry; see features for `large`."""
    pairs = df.select(*by, clean(x).alias("__x"), clean(y).alias("__y")).dropna(subset=["__x", "__y"])
    if is_large(df, by, large):
        return huge_groups.rank_feature(huge_groups.rank_feature(pairs, "__x", "__rx", by, False), "__y", "__ry", by, False)
    return pairs.withColumns({"__rx": average_rank("__x", by, None), "__ry": average_rank("__y", by, None)})


def information_coefficient(df: DataFrame, factor: str, ret: str, date: str, by: list[str] | None = None) -> DataFrame:
    """date, ic: Pearson correlation of factor and return; every date comes out, null below three pairs."""
    keys = [*(by or []), date]
    return df.groupBy(*keys).agg(safe_corr(clean(factor), clean(ret)).alias("ic"))


def rank_ic(df: DataFrame, factor: str, ret: str, date: str, by: list[str] | None = None, large: bool | None = None) -> DataFrame:
    """date, ic: Spearman correlation, ranks taken over complete pairs."""
    keys = [*(by or []), date]
    dates = df.select(*keys).distinct()
    got = ranked_pairs(df, factor, ret, keys, large).groupBy(*keys).agg(safe_corr("__rx", "__ry").alias("ic"))
    return dates.join(got, keys, "left")


def ic_summary(ic: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mean_ic, std_ic (population), icir, pct_positive, n of the non-null coefficients."""
    x = F.col("ic")
    out = ic.groupBy(*(by or [])).agg(F.avg(x).alias("mean_ic"), F.stddev_pop(x).alias("std_ic"), F.avg((x > 0).cast("double")).alias("pct_positive"), F.count(x).alias("n"))
    return out.withColumn("icir", F.try_divide(F.col("mean_ic"), F.when(F.col("std_ic") > 1e-15, F.col("std_ic"))))


def forward_product(ret: Column, h: int, entity: str | list[str], order: list[str]) -> Column:
    """Product of (1 + r) over this and the next h - 1 rows, less 1; null if any is missing."""
    w = Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*order).rowsBetween(0, h - 1)
    return F.when(F.count(ret).over(w) == h, F.product(1 + ret).over(w) - 1)


def factor_decay(df: DataFrame, factor: str, ret: str, date: str, entity: str, horizons: int = 12, order: tuple[str, ...] = (), by: list[str] | None = None, digits: int | None = None, large: bool | None = None) -> DataFrame:
    """Rank IC summary per (by and) horizon 1..horizons; all horizons run as one grouped job.

    `digits` rounds the compounded returns before they are ranked, so that equal ones stay ties.
    """
    keys = by or []
    total = lambda h: forward_product(clean(ret), h, [*keys, entity], [date, *order])
    cum = F.array(*[F.struct(F.lit(h).alias("horizon"), (total(h) if digits is None else F.round(total(h), digits)).alias("__r")) for h in range(1, horizons + 1)])
    long = df.select(*keys, date, factor, cum.alias("__all")).select(*keys, date, factor, F.inline("__all"))
    return ic_summary(rank_ic(long, factor, "__r", date, [*keys, "horizon"], large), [*keys, "horizon"])


def quantile_returns(df: DataFrame, factor: str, ret: str, date: str, n: int = 5, weight: str | None = None, by: list[str] | None = None, large: bool | None = None) -> DataFrame:
    """Long form: (by,) date, bucket, ret, n; mean or weighted mean return of each factor bucket."""
    keys = [*(by or []), date]
    b = quantile_buckets(df, factor, "bucket", keys, n, large=large).where("bucket is not null")
    value = weighted_mean(clean(ret), clean(weight)) if weight else F.avg(clean(ret))
    return b.groupBy(*keys, "bucket").agg(value.alias("ret"), F.count(clean(ret)).alias("n"))


def quantile_matrix(returns: DataFrame, date: str, n: int = 5) -> DataFrame:
    """date x bucket matrix with columns q1..qn."""
    return returns.groupBy(date).pivot("bucket", list(range(1, n + 1))).agg(F.first("ret")).select(date, *[F.col(str(i)).alias(f"q{i}") for i in range(1, n + 1)])


def long_short(returns: DataFrame, date: str, long: int | None = None, short: int = 1, by: list[str] | None = None) -> DataFrame:
    """(by,) date, ret: long bucket (default: the highest that occurs) less the short one; null if either is missing."""
    top, keys = F.lit(long) if long else F.col("__top"), by or []
    if not long:  # returns have a row per date and bucket
        most = returns.groupBy(*keys).agg(F.max("bucket").alias("__top"))
        returns = returns.join(F.broadcast(most), keys if keys else F.lit(True))
    return returns.groupBy(*keys, date).agg((F.max(F.when(F.col("bucket") == top, F.col("ret"))) - F.max(F.when(F.col("bucket") == short, F.col("ret")))).alias("ret"))


def cumulative(series: DataFrame, date: str, ret: str = "ret", by: list[str] | None = None, nulls_as_zero: bool = False) -> DataFrame:
    """Adds growth (product of 1 + r up to the date), peak and drawdown. For one row per date; null returns are dropped or count as 0."""
    r = F.coalesce(F.col(ret), F.lit(0.0)) if nulls_as_zero else F.col(ret)
    s = series if nulls_as_zero else series.where(F.col(ret).isNotNull())
    w = Window.partitionBy(*(by or [])).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("growth", F.product(1 + r).over(w)).withColumn("peak", F.max("growth").over(w))
    return s.withColumn("drawdown", F.try_divide(F.col("growth"), F.col("peak")) - 1)


def performance_stats(series: DataFrame, date: str, ret: str = "ret", periods: int = 12, rf: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """ann_return, ann_vol (population), sharpe, max_drawdown (peak from the first value), cumulative_return, n; no row for an empty series."""
    e = F.col(ret) - rf / periods
    last = F.max_by("growth", date)
    s = cumulative(series, date, ret, by).groupBy(*(by or [])).agg((F.avg(e) * periods).alias("ann_return"), (F.stddev_pop(e) * F.sqrt(F.lit(float(periods)))).alias("ann_vol"), F.min("drawdown").alias("max_drawdown"), (last - 1).alias("cumulative_return"), F.count(ret).alias("n"))
    return s.where("n > 0").withColumn("sharpe", F.try_divide(F.col("ann_return"), F.when(F.col("ann_vol") > 1e-15, F.col("ann_vol"))))


def rolling_sharpe(series: DataFrame, date: str, window: int, periods: int = 12, ret: str = "ret", by: list[str] | None = None) -> DataFrame:
    """date, sharpe over the last `window` values; null before the window is full or where its deviation is 0."""
    w = Window.partitionBy(*(by or [])).orderBy(date).rowsBetween(1 - window, 0)
    r = F.col(ret)
    sd = F.stddev_pop(r).over(w)
    return series.select(*(by or []), date, F.when(F.count(r).over(w) == window, F.try_divide(F.avg(r).over(w), F.when(sd > 1e-15, sd)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def rolling_mean(series: DataFrame, date: str, window: int, value: str, out: str) -> DataFrame:
    """Moving average over a full window, else null."""
    w = Window.orderBy(date).rowsBetween(1 - window, 0)
    return series.withColumn(out, F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def correlation_pairs(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """col_x, col_y, corr of every pair (both orders and the diagonal) over pairwise complete rows, in one pass."""
    aggs = [safe_corr(clean(a), clean(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    one = df.groupBy(*(by or [])).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"), F.col(f"{min(i, j)}_{max(i, j)}").alias("corr")) for i, a in enumerate(cols) for j, b in enumerate(cols)])
    return one.select(*(by or []), F.inline(cells))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """bin (1..bins), low, n of equal-width bins between the least and greatest value, empty ones included; no rows without values."""
    x = clean(col)
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi")).where("__lo is not null")
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col("__x") - F.col("__lo"), width)), F.lit(0)) + 1, F.lit(bins)).cast("int")
    counts = df.select(x.alias("__x")).where("__x is not null").join(F.broadcast(ends), F.lit(True)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), (F.col("__lo") + (F.col("bin") - 1) * width).alias("low"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def kernel_density(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """x, density: Gaussian kernel estimate at equal steps between the least and greatest value, Scott's width n ** -0.2 x std (sample).

    Every value adds to every point, as sums that merge map-side; a row per point comes out. Nothing for constant or no values.
    """
    x = clean(col)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n")).where("n > 1 and sd > 0")
    d = df.select(x.alias("__x")).where("__x is not null").join(F.broadcast(ends.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))), F.lit(True))
    at = [F.col("lo") + (F.col("hi") - F.col("lo")) * (k / (points - 1)) for k in range(points)]
    sums = d.groupBy("lo", "hi", "h", "n").agg(F.array(*[F.sum(F.exp(-0.5 * ((F.col("__x") - a) / F.col("h")) * ((F.col("__x") - a) / F.col("h")))) for a in at]).alias("s"))
    rows = sums.select("lo", "hi", "h", "n", F.posexplode("s").alias("k", "s"))
    return rows.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") / (points - 1))).alias("x"), (F.col("s") / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))

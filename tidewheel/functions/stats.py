"""Statistics as columns: null-safe, ANSI-safe, and evaluated in the JVM.

NaN counts as missing everywhere; use `clean` at the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN becomes null."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def average_rank(x: Column | str, by: list[str], window) -> Column:
    """1-based rank with ties averaged, null where x is null; `window` partitions by `by`."""
    x = _c(x)
    from pyspark.sql import Window

    # nulls form a partition of their own, so they neither rank nor count
    has = x.isNotNull()
    first = F.rank().over(Window.partitionBy(*by, has).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, has, x))
    return F.when(has, first + (ties - 1) / 2)


def percent_rank(x: Column | str, by: list[str]) -> Column:
    """Average rank divided by the count of non-null values of the partition."""
    from pyspark.sql import Window

    return average_rank(x, by, None) / F.count(_c(x)).over(Window.partitionBy(*by))


def quantile_bucket(x: Column | str, n: int, window: WindowSpec) -> Column:
    """1-based bucket of n by linear-interpolated quantiles, equal edges dropped.

    Intervals are closed on the right, the first on both sides. Null for null values and where all edges
    coincide; so ties collapse buckets and labels stay contiguous from 1.
    """
    x = _c(x)
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)])).over(window))
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNull() | (F.size(edges) < 2), None).when(x == edges[0], 1).otherwise(below).cast("int")


def safe_corr(x: Column | str, y: Column | str, least: int = 3) -> Column:
    """Pearson correlation of complete pairs; null below `least` pairs or where a side is constant."""
    x, y = _c(x), _c(y)
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= least, F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-300, spread)))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Sum(w x) / sum(w) over complete pairs; null where the weights add up to 0."""
    x, w = _c(x), _c(w)
    ok = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))

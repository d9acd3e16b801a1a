"""Cross-sectional and per-entity features of a long panel (date, entity, values).

Every function takes a DataFrame and returns it with a column added; null stays null and NaN counts as null.
Histories are windows over the entity. A cross-section is a window over the date as long as no date has more than
WINDOW_ROWS rows; beyond that the same numbers come from merged sums, refined histograms and counted values
(`huge_groups`), so that no task holds a date. Pass `large` where it is known; otherwise the rows are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.stats import average_rank, clean, clip, percent_rank, quantile_bucket
from tidewheel.operators import huge_groups

#: Rows of a group that one task sorts and holds easily.
WINDOW_ROWS = 5_000_000


def is_large(df: DataFrame, by: list[str], large: bool | None = None) -> bool:
    """`large` if it is given, else whether a group has more than WINDOW_ROWS rows (a count, merged map-side)."""
    if large is not None:
        return large
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > WINDOW_ROWS


def winsorize(df: DataFrame, col: str, out: str, by: list[str] | None = None, lower: float = 0.01, upper: float = 0.99, large: bool | None = None) -> DataFrame:
    """Clip to linear-interpolated quantiles, per group of `by` or (None) over the whole table.

    The global form computes the two quantiles as an aggregate and joins the one row, instead of a window over
    everything.
    """
    x = clean(col)
    at = F.array(F.lit(lower), F.lit(upper))
    if is_large(df, by or [], large):
        if by:
            return huge_groups.winsorize(df, col, out, by, lower, upper)
        return huge_groups.winsorize(df.withColumn("__all", F.lit(0)), col, out, ["__all"], lower, upper).drop("__all")
    if by:
        q = F.percentile(x, at).over(Window.partitionBy(*by))
        return df.withColumn("__q", q).withColumn(out, clip(x, F.col("__q")[0], F.col("__q")[1])).drop("__q")
    q = df.agg(F.percentile(x, at).alias("__q"))
    return df.join(F.broadcast(q), F.lit(True)).withColumn(out, clip(x, F.col("__q")[0], F.col("__q")[1])).drop("__q")


def zscore(df: DataFrame, col: str, out: str, by: list[str] | None = None, large: bool | None = None) -> DataFrame:
    """(x - mean) / population deviation; null where the deviation is 0 or unknown."""
    x = clean(col)
    if by and is_large(df, by, large):
        return huge_groups.zscore(df, col, out, by)
    if by:
        w = Window.partitionBy(*by)
        return df.withColumn(out, F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w)))
    s = df.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    return df.join(F.broadcast(s), F.lit(True)).withColumn(out, F.try_divide(x - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def group_neutralize(df: DataFrame, col: str, out: str, by: list[str], large: bool | None = None) -> DataFrame:
    """x less the mean of its group; null where a key of the group is null."""
    if is_large(df, by, large):
        return huge_groups.group_neutralize(df, col, out, by)
    x = clean(col)
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    return df.withColumn(out, F.when(known, x - F.avg(x).over(Window.partitionBy(*by))))


def size_neutralize(df: DataFrame, col: str, size: str, out: str, by: list[str], least: float = 1e-9, large: bool | None = None) -> DataFrame:
    """Residual of x on [1, ln(max(size, least))] within each group; null for incomplete rows and below two of them.

    A group of one size has slope 0, so its residual is x less the mean.
    """
    if is_large(df, by, large):
        return huge_groups.size_neutralize(df, col, size, out, by, least)
    x, s = clean(col), F.log(F.greatest(clean(size), F.lit(least)))
    ok = x.isNotNull() & clean(size).isNotNull()
    y, z = F.when(ok, x), F.when(ok, s)
    w = Window.partitionBy(*by)
    vz = F.var_pop(z).over(w)
    slope = F.coalesce(F.try_divide(F.covar_pop(y, z).over(w), F.when(vz > 1e-18, vz)), F.lit(0.0))
    return df.withColumn(out, F.when(ok & (F.count(y).over(w) >= 2), x - F.avg(y).over(w) - slope * (s - F.avg(z).over(w))))


def lag_feature(df: DataFrame, col: str, out: str, entity: str, order: list[str], periods: int = 1) -> DataFrame:
    """Value `periods` rows (not calendar steps) earlier of the same entity; `order` must break ties."""
    return df.withColumn(out, F.lag(col, periods).over(Window.partitionBy(entity).orderBy(*order)))


def rank_feature(df: DataFrame, col: str, out: str, by: list[str], pct: bool = True, large: bool | None = None) -> DataFrame:
    """Average rank within the group, divided by its non-null count if pct."""
    if is_large(df, by, large):
        return huge_groups.rank_feature(df, col, out, by, pct)
    return df.withColumn(out, percent_rank(clean(col), by) if pct else average_rank(clean(col), by, None))


def quantile_buckets(df: DataFrame, col: str, out: str, by: list[str], n: int = 5, base: int = 1, large: bool | None = None) -> DataFrame:
    """Quantile bucket base..base+n-1 within the group, equal edges dropped."""
    if is_large(df, by, large):
        return huge_groups.quantile_buckets(df, col, out, by, n, base)
    return df.withColumn(out, quantile_bucket(clean(col), n, Window.partitionBy(*by)) + F.lit(base - 1))


def validate_feature(df: DataFrame, col: str, max_null_share: float = 0.2) -> DataFrame:
    """One-row report: feature, n, n_null, null_share, n_unique, mean, std (sample), min, max, passed."""
    x = clean(col)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count_distinct(x).alias("n_unique"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    share = F.try_divide(F.col("n_null").cast("double"), F.col("n"))
    passed = F.coalesce((share <= max_null_share) & (F.col("n_unique") > 1), F.lit(False))
    return r.select(F.lit(col).alias("feature"), "n", "n_null", share.alias("null_share"), "n_unique", "mean", "std", "min", "max", passed.alias("passed"))


def feature_pipeline(df: DataFrame, cols: list[str], date: str, entity: str, group: str | None = None, size: str | None = None, log_cols: tuple[str, ...] = (), order: tuple[str, ...] = (), lower: float = 0.01, upper: float = 0.99, lag: int = 1, fallback: bool = True, large: bool | None = None, digits: int | None = None) -> DataFrame:
    """All stages for every column: _log (of log_cols), _w, _z, _ind_neutral, _cap_neutral, _lagged, _rank.

    A stage that gives null falls back to the one before (with `fallback`). Stages are derived for all columns
    together, so the windows of a stage share one sort per key set. Columns that are missing are skipped;
    `order` breaks ties of (entity, date). Dates are counted once; with large ones the table is read once a stage, so
    hand in one that is stored. `digits` rounds what is ranked, so that sums taken in another order don't break ties.
    """
    large = is_large(df, [date], large)
    cols = [c for c in cols if c in df.columns]
    by = [date]
    now = {c: c for c in cols}
    for c in cols:
        if c in log_cols:
            df = df.withColumn(f"{c}_log", F.log1p(F.when(clean(c).isNotNull(), F.greatest(clean(c), F.lit(0.0)))))
            now[c] = f"{c}_log"
    for c in cols:
        df = winsorize(df, now[c], f"{c}_w", by, lower, upper, large)
    for c in cols:
        df = zscore(df, f"{c}_w", f"{c}_z", by, large)
        now[c] = f"{c}_z"
    back = lambda new, old: F.coalesce(new, F.col(old)) if fallback else new
    if group:
        for c in cols:
            df = group_neutralize(df, now[c], f"{c}_ind_neutral", [date, group], large).withColumn(f"{c}_ind_neutral", back(F.col(f"{c}_ind_neutral"), now[c]))
            now[c] = f"{c}_ind_neutral"
    if size:
        for c in cols:
            df = size_neutralize(df, now[c], size, f"{c}_cap_neutral", by, large=large).withColumn(f"{c}_cap_neutral", back(F.col(f"{c}_cap_neutral"), now[c]))
            now[c] = f"{c}_cap_neutral"
    for c in cols:
        df = lag_feature(df, now[c], f"{c}_lagged", entity, [date, *order], lag)
    for c in cols:
        if digits is None:
            df = rank_feature(df, f"{c}_lagged", f"{c}_rank", by, large=large)
        else:
            df = rank_feature(df.withColumn("__ranked", F.round(f"{c}_lagged", digits)), "__ranked", f"{c}_rank", by, large=large).drop("__ranked")
    return df


def pca_composites(df: DataFrame, cols: list[str], n: int, date: str, large: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with pc1..pcn, loadings): principal components of per-date z-scores over complete rows.

    Means and the covariance are one aggregate of k (k + 3) / 2 sums; only that k x k matrix is solved on the
    driver. Each component's largest loading in size is positive. Incomplete rows get null. Raises ValueError if
    fewer than n rows are complete. loadings: component, feature..., explained_variance_ratio.
    """
    import numpy as np

    z = {c: f"__z_{c}" for c in cols}
    large = is_large(df, [date], large)
    for c in cols:
        df = zscore(df, c, z[c], [date], large)
    names = list(z.values())
    whole = df.dropna(subset=names)
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = whole.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if s["n"] < max(n, 2):
        raise ValueError(f"{s['n']} complete rows for {n} components")
    mean, cov = np.array([s[f"m{i}"] for i in range(k)]), np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = s[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:n]
    vectors = vectors[:, top] * np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top])
    ratio = values[top] / values.sum()
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    for p in range(len(top)):
        score = sum(((F.col(c) - F.lit(float(mean[i]))) * F.lit(float(vectors[i, p])) for i, c in enumerate(names)), F.lit(0.0))
        df = df.withColumn(f"pc{p + 1}", F.when(complete, score))
    rows = [(f"pc{p + 1}", *map(float, vectors[:, p]), float(ratio[p])) for p in range(len(top))]
    loadings = df.sparkSession.createDataFrame(rows, "component string, " + ", ".join(f"`{c}` double" for c in cols) + ", explained_variance_ratio double")
    return df.drop(*names), loadings


def transform_grid(df: DataFrame, grid: dict[str, list], transform: Callable[..., DataFrame]) -> list[tuple[dict, DataFrame]]:
    """(parameters, transform(df, **parameters)) of every combination of the grid."""
    import itertools

    keys = list(grid)
    return [(p := dict(zip(keys, values)), transform(df, **p)) for values in itertools.product(*grid.values())]

"""Per-date regressions, Fama-MacBeth with Newey-West errors, robustness and out-of-sample tests.

Regressions are solved from Gram sums, which merge map-side, so no date's rows are gathered: one row of
k (k + 3) / 2 sums per date goes to a small vectorised solve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.distributions import normal_two_sided, t_two_sided
from tidewheel.functions.stats import clean
from tidewheel.operators.features import transform_grid


def _grams(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """n, means and centred cross products (population) of y and xs over complete rows of each group."""
    cols = [y, *xs]
    d = df.select(*by, *[clean(c).alias(f"__{i}") for i, c in enumerate(cols)]).dropna(subset=[f"__{i}" for i in range(len(cols))])
    moments = [F.covar_pop(f"__{i}", f"__{j}").alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"__{i}").alias(f"m{i}") for i in range(len(cols))], *moments)


def solve_gram(n, means, cov):
    """Coefficients (constant first), t-statistics and R2 of y (index 0) on the rest, or nulls where undefined.

    A regressor that is constant takes the place of the constant, so then the constant is null and its
    coefficient is that of the mean; rank-deficient systems get the least-norm solution.
    """
    import numpy as np

    k = len(means) - 1
    flat = np.diag(cov)[1:] <= 1e-12 * np.maximum(1.0, means[1:] ** 2)
    x = n * (np.block([[np.ones((1, 1)), means[None, 1:]], [means[1:, None], cov[1:, 1:] + np.outer(means[1:], means[1:])]]))
    xy = n * np.concatenate([[means[0]], cov[1:, 0] + means[1:] * means[0]])
    use = np.array([not flat.any(), *[True] * k])
    inv = np.linalg.pinv(x[np.ix_(use, use)], hermitian=True)
    beta = np.full(k + 1, np.nan)
    beta[use] = inv @ xy[use]
    syy = n * cov[0, 0]
    slope = np.nan_to_num(beta[1:]) * ~flat
    rss = max(0.0, syy - 2 * n * slope @ cov[1:, 0] + n * slope @ cov[1:, 1:] @ slope)
    rank = int(np.linalg.matrix_rank(x[np.ix_(use, use)], hermitian=True))
    free = n - rank
    t = np.full(k + 1, np.nan)
    if free > 0 and rss > 1e-14 * max(syy, 1e-300):
        se = np.sqrt(np.maximum(np.diag(inv), 0) * rss / free)
        t[use] = np.divide(beta[use], se, out=np.full(use.sum(), np.nan), where=se > 0)
    return beta, t, (1 - rss / syy if syy > 0 else np.nan)


def cross_sectional_regression(df: DataFrame, y: str, xs: list[str], date: str, by: list[str] | None = None) -> DataFrame:
    """date, coef_const, coef_<x>, tstat_const, tstat_<x>, r_squared, n_obs per date with more than k + 1 complete rows."""
    keys = [*(by or []), date]
    grams = _grams(df, y, xs, keys).where(F.col("n") > len(xs) + 1)
    names = ["const", *xs]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.select(*keys).schema.fields)
    schema = f"{fields}, " + ", ".join([f"`coef_{x}` double" for x in names] + [f"`tstat_{x}` double" for x in names]) + ", r_squared double, n_obs bigint"

    def solve(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        size = len(xs) + 1
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                means = np.array([r[f"m{i}"] for i in range(size)])
                cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
                beta, t, r2 = solve_gram(r["n"], means, cov)
                rows.append([*[r[k] for k in keys], *beta, *t, r2, r["n"]])
            out = pd.DataFrame(rows, columns=[*keys, *[f"coef_{x}" for x in names], *[f"tstat_{x}" for x in names], "r_squared", "n_obs"])
            yield out.astype({c: object for c in out.columns if out[c].dtype == float}).where(out.notna(), None)

    return grams.mapInPandas(solve, schema)


def simple_regression(df: DataFrame, y: str, x: str, date: str, by: list[str] | None = None) -> DataFrame:
    """The same for one regressor, all in the JVM: date, coef_const, coef_x, tstat_const, tstat_x, r_squared, n_obs."""
    keys = [*(by or []), date]
    d = df.select(*keys, clean(y).alias("__y"), clean(x).alias("__x")).dropna(subset=["__y", "__x"])
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.regr_slope("__y", "__x").alias("b"), F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.regr_sxx("__y", "__x").alias("sxx"), F.regr_syy("__y", "__x").alias("syy"), F.regr_sxy("__y", "__x").alias("sxy")).where("n_obs > 2 and sxx > 0")
    rss = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    var = rss / (F.col("n_obs") - 2)
    a = F.col("my") - F.col("b") * F.col("mx")
    se_b, se_a = F.sqrt(var / F.col("sxx")), F.sqrt(var * (1 / F.col("n_obs") + F.col("mx") * F.col("mx") / F.col("sxx")))
    return s.select(*keys, a.alias("coef_const"), F.col("b").alias("coef_x"), F.try_divide(a, se_a).alias("tstat_const"), F.try_divide(F.col("b"), se_b).alias("tstat_x"), (1 - F.try_divide(rss, F.col("syy"))).alias("r_squared"), "n_obs")


@F.pandas_udf(T.DoubleType())
def _p_normal(t: pd.Series) -> pd.Series:
    """Two-sided normal p-values; one row per series."""
    return pd.Series([normal_two_sided(None if v != v else v) for v in t.astype("float64")], dtype="float64")


def newey_west(series: DataFrame, date: str, value: str, lags: int = 3, by: list[str] | None = None) -> DataFrame:
    """mean, se, tstat, pvalue, n of a per-date series: Bartlett weights, lags by position, no small-sample factor."""
    keys = by or []
    w = Window.partitionBy(*keys)
    o = w.orderBy(date)
    s = series.where(F.col(value).isNotNull()).withColumn("__u", F.col(value) - F.avg(value).over(w))
    s = s.withColumns({f"__p{j}": F.col("__u") * (F.lag("__u", j).over(o) if j else F.col("__u")) for j in range(lags + 1)})
    long_run = F.sum("__p0") + sum((2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"__p{j}"), F.lit(0.0)) for j in range(1, lags + 1)), F.lit(0.0))
    out = s.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(long_run >= 0, F.sqrt(F.greatest(long_run, F.lit(0.0))) / F.count(value)).alias("se"), F.count(value).alias("n")).where("n > 0")
    t = F.try_divide(F.col("mean"), F.when(F.col("se") > 0, F.col("se")))
    return out.withColumn("tstat", t).withColumn("pvalue", _p_normal("tstat"))


def fama_macbeth(df: DataFrame, y: str, xs: list[str], date: str, lags: int = 3, by: list[str] | None = None) -> DataFrame:
    """variable, mean, se, tstat, pvalue, n: averages of the per-date coefficients, constant included; empty without dates."""
    reg = cross_sectional_regression(df, y, xs, date, by)
    names = ["const", *xs]
    long = reg.select(*(by or []), date, F.inline(F.array(*[F.struct(F.lit(x).alias("variable"), F.col(f"coef_{x}").alias("__b")) for x in names])))
    return newey_west(long, date, "__b", lags, [*(by or []), "variable"])


def robustness_test(df: DataFrame, y: str, xs: list[str], date: str, control_specs: list[list[str]], by: list[str] | None = None) -> DataFrame:
    """(by,) spec, controls ('none' or comma-joined) and the Fama-MacBeth rows of xs, for each set of controls; three lags."""
    out = None
    for i, controls in enumerate(control_specs):
        r = fama_macbeth(df, y, [*xs, *controls], date, by=by).where(F.col("variable").isin(xs))
        r = r.select(*(by or []), F.lit(i).alias("spec"), F.lit(",".join(controls) or "none").alias("controls"), "variable", "mean", "se", "tstat", "pvalue", "n")
        out = r if out is None else out.unionByName(r)
    return out


def subsample_analysis(df: DataFrame, y: str, xs: list[str], date: str, split: str, lags: int = 3) -> DataFrame:
    """Fama-MacBeth per distinct non-null value of `split`, in one job."""
    return fama_macbeth(df.where(F.col(split).isNotNull()), y, xs, date, lags, [split])


def sensitivity_analysis(df: DataFrame, y: str, xs: list[str], date: str, grid: dict[str, list], transform: Callable[..., DataFrame]) -> DataFrame:
    """Fama-MacBeth after transform(df, **parameters) for every combination of the grid; parameters as string columns."""
    out = None
    for params, d in transform_grid(df, grid, transform):
        r = fama_macbeth(d, y, xs, date).select(*[F.lit(str(v)).alias(k) for k, v in params.items()], "variable", "mean", "se", "tstat", "pvalue", "n")
        out = r if out is None else out.unionByName(r)
    return out


def out_of_sample(df: DataFrame, y: str, xs: list[str], date: str, train_share: float = 0.7, by: list[str] | None = None) -> DataFrame:
    """(by,) n_train, n_test, in_sample_r2, oos_r2. Dates are split in order before incomplete rows are dropped.

    The pooled fit uses the rows of the first int(dates x train_share) dates of the table; oos_r2 is 1 - SSres / SStot around
    the test mean, computed from the test rows' Gram sums. One row (per group of `by`, which must be few), none where a side
    has no complete rows.
    """
    import numpy as np

    keys = by or []
    dates = [r[0] for r in df.select(date).where(F.col(date).isNotNull()).distinct().orderBy(date).collect()]  # one value per date
    cut = int(len(dates) * train_share)
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, t()) for c, t in (("n_train", T.LongType), ("n_test", T.LongType), ("in_sample_r2", T.DoubleType), ("oos_r2", T.DoubleType))]])
    if cut == 0 or cut >= len(dates):
        return df.sparkSession.createDataFrame([], schema)
    size, got = len(xs) + 1, {}
    for r in _grams(df.withColumn("__test", F.col(date) >= F.lit(dates[cut])).where("__test is not null"), y, xs, [*keys, "__test"]).collect():
        got.setdefault(tuple(r[k] for k in keys), {})[r["__test"]] = (r["n"], np.array([r[f"m{i}"] for i in range(size)]), np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]))
    rows = []
    for key, sides in got.items():
        if len(sides) < 2:
            continue
        beta, _, r2 = solve_gram(*sides[False])
        n, m, c = sides[True]
        b = np.nan_to_num(beta)
        bias = m[0] - b[0] - b[1:] @ m[1:]
        rss = n * (c[0, 0] - 2 * b[1:] @ c[1:, 0] + b[1:] @ c[1:, 1:] @ b[1:] + bias**2)
        tss = n * c[0, 0]
        rows.append((*key, int(sides[False][0]), int(n), float(r2) if r2 == r2 else None, float(1 - rss / tss) if tss > 0 else None))
    return df.sparkSession.createDataFrame(rows, schema)


def significance_test(mean: float, se: float, n: int, alpha: float = 0.05) -> dict:
    """Two-sided t test with max(n - 1, 1) degrees of freedom; not significant where se is 0 or missing."""
    if not se or se != se or mean is None:
        return {"tstat": None, "pvalue": None, "significant": False}
    t = mean / se
    p = t_two_sided(t, max(n - 1, 1))
    return {"tstat": t, "pvalue": p, "significant": p < alpha}

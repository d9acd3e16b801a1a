"""Cross-sectional features where a date holds more rows than one task should sort.

The window forms in `features` give a date to one task, so they pass larger dates on to these. They give the same numbers from aggregates that merge
map-side (moments), from histogram refinement (quantiles) and from counted values with two-level prefix sums
(ranks); what is joined back has a row per date, or is salted for frequent values. The table is read several
times, so hand in one that is stored or persisted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.stats import clean, clip
from tidewheel.operators.keyed_selection import _encode, _select
from tidewheel.operators.skew import HOT_ROWS, HOT_SHARE, null_safe, prefix_sums, skew_safe_left_join


def _attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Left join of one row per group, null keys included."""
    s = stats.select(*[F.col(k).alias(f"__k_{k}") for k in by], *[c for c in stats.columns if c not in by])
    on = F.lit(True)
    for k in by:
        on = on & df[k].eqNullSafe(s[f"__k_{k}"])
    return df.join(s, on, "left").drop(*[f"__k_{k}" for k in by])


def interpolated_quantiles(df: DataFrame, by: list[str], col: str, probs: list[float], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """by, q: array of linear-interpolated quantiles of the non-null doubles of each group; groups without any are left out.

    Groups of at least max(share x rows, least) values (so at most 1 / share) are refined by histograms; the others
    are aggregated.
    """
    import numpy as np

    rows = _encode(df.select(*by, clean(col).alias("__v")), "__v")
    floor = max(int(share * df.count()), least)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__u").alias("lo"), F.max("__u").alias("hi")).where(F.col("n") >= floor).collect()
    cold = rows
    done = None
    if sizes:
        targets, wants = {}, {}
        for r in sizes:
            k, n = tuple(r[b] for b in by), r["n"]
            at = [p * (n - 1) for p in probs]
            wants[k] = [(math.floor(a) + 1, min(math.floor(a) + 2, n), a - math.floor(a)) for a in at]
            targets[k] = sorted({x for lo, hi, _ in wants[k] for x in (lo, hi)})
        u = {(*x[:-3], x[-3]): x[-2] for x in _select(rows, by, targets, min(r["lo"] for r in sizes), max(r["hi"] for r in sizes))}

        def value(code: int) -> float:
            bits = np.array([code], "int64")
            return float(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view("float64")[0])

        got = [(*k, [value(u[(*k, lo)]) * (1 - f) + value(u[(*k, hi)]) * f for lo, hi, f in w]) for k, w in wants.items()]
        done = df.sparkSession.createDataFrame(got, T.StructType([*[T.StructField(b, df.schema[b].dataType) for b in by], T.StructField("q", T.ArrayType(T.DoubleType()))]))
        few = F.broadcast(done.select(*by))
        cold = rows.join(few, null_safe(rows, few, by), "left_anti")
    out = cold.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    return out if done is None else out.unionByName(done)


def winsorize(df: DataFrame, col: str, out: str, by: list[str], lower: float = 0.01, upper: float = 0.99, **limits) -> DataFrame:
    """As features.winsorize."""
    d = _attach(df, interpolated_quantiles(df, by, col, [lower, upper], **limits).withColumnRenamed("q", "__q"), by)
    return d.withColumn(out, clip(clean(col), F.col("__q")[0], F.col("__q")[1])).drop("__q")


def zscore(df: DataFrame, col: str, out: str, by: list[str]) -> DataFrame:
    """As features.zscore."""
    x = clean(col)
    d = _attach(df, df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s")), by)
    return d.withColumn(out, F.try_divide(x - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def group_neutralize(df: DataFrame, col: str, out: str, by: list[str]) -> DataFrame:
    """As features.group_neutralize."""
    x, known = clean(col), F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    d = _attach(df, df.groupBy(*by).agg(F.avg(x).alias("__m")), by)
    return d.withColumn(out, F.when(known, x - F.col("__m"))).drop("__m")


def size_neutralize(df: DataFrame, col: str, size: str, out: str, by: list[str], least: float = 1e-9) -> DataFrame:
    """As features.size_neutralize."""
    x, s = clean(col), F.log(F.greatest(clean(size), F.lit(least)))
    ok = x.isNotNull() & clean(size).isNotNull()
    y, z = F.when(ok, x), F.when(ok, s)
    d = _attach(df, df.groupBy(*by).agg(F.avg(y).alias("__my"), F.avg(z).alias("__mz"), F.covar_pop(y, z).alias("__c"), F.var_pop(z).alias("__vz"), F.count(y).alias("__n")), by)
    slope = F.coalesce(F.try_divide(F.col("__c"), F.when(F.col("__vz") > 1e-18, F.col("__vz"))), F.lit(0.0))
    return d.withColumn(out, F.when(ok & (F.col("__n") >= 2), x - F.col("__my") - slope * (s - F.col("__mz")))).drop("__my", "__mz", "__c", "__vz", "__n")


def quantile_buckets(df: DataFrame, col: str, out: str, by: list[str], n: int = 5, base: int = 1, **limits) -> DataFrame:
    """As features.quantile_buckets."""
    x: Column = clean(col)
    edges = interpolated_quantiles(df, by, col, [i / n for i in range(n + 1)], **limits).select(*by, F.array_distinct("q").alias("__q"))
    d = _attach(df, edges, by)
    e = F.col("__q")
    bucket = F.when(x.isNull() | F.coalesce(F.size(e) < 2, F.lit(True)), None).when(x == e[0], 1).otherwise(F.size(F.filter(e, lambda v: v < x)))
    return d.withColumn(out, bucket.cast("int") + F.lit(base - 1)).drop("__q")


def rank_feature(df: DataFrame, col: str, out: str, by: list[str], pct: bool = True) -> DataFrame:
    """As features.rank_feature: equal values are counted first, counts are summed by two-level prefix sums."""
    rows = _encode(df.select(*by, clean(col).alias("__v")), "__v")
    values = rows.groupBy(*by, "__v", "__u").agg(F.count(F.lit(1)).alias("__c"))
    ends = rows.agg(F.min("__u"), F.max("__u")).first()
    shift = max(0, ((ends[1] or 0) - (ends[0] or 0)).bit_length() - 14)
    keyed = values.withColumn("__key", F.struct(*by)).withColumn("__piece", F.shiftright("__u", shift))
    ranked = prefix_sums(keyed, ["__key"], "__piece", ["__u"], "__c", "earlier").select("__key", "__v", (F.col("earlier") + (F.col("__c") + 1) / 2).alias("__r"))
    d = df.withColumns({"__key": F.struct(*by), "__v": clean(col) + F.lit(0.0)})
    d = skew_safe_left_join(d, ranked, ["__key", "__v"]).drop("__v", "__key")
    if not pct:
        return d.withColumnRenamed("__r", out)
    return _attach(d, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by).withColumn(out, F.col("__r") / F.col("__n")).drop("__r", "__n")


def _places(df: DataFrame, by: list[str], order: list, descending: bool) -> DataFrame:
    """`df` (with __u) and the number of rows of the group before each in the order of __u, then `order`."""
    u = F.bitwise_not("__u") if descending else F.col("__u")
    ends = df.agg(F.min("__u"), F.max("__u")).first()
    shift = max(0, ((ends[1] or 0) - (ends[0] or 0)).bit_length() - 14)
    rows = df.withColumns({"__key": F.struct(*by), "__w": u, "__piece": F.shiftright(u, shift), "__one": F.lit(1).cast("bigint")})
    name = "__high" if descending else "__low"
    return prefix_sums(rows, ["__key"], "__piece", ["__w", *order], "__one", name).drop("__key", "__w", "__piece", "__one")


def sorted_groups(df: DataFrame, factor: str, by: list[str], groups: int, order: list) -> DataFrame:
    """As portfolio.sorted_groups; rows of equal value are one task's work."""
    rows = _encode(df.withColumn("__x", clean(factor)), "__x")
    rows = _places(_places(rows, by, order, True), by, order, False)
    d = _attach(rows, rows.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / groups)).alias("__size")), by)
    side = F.when(F.col("__high") < F.col("__size"), "high").when(F.col("__low") < F.col("__size"), "low")
    return d.withColumn("side", side).where("side is not null").drop("__x", "__u", "__high", "__low", "__size")

"""Per-key results where a few keys hold most rows (problem 1).

Exact order statistics without sorting or gathering a key's values: each round counts the values of every
hot key in equal bins, with counts that merge map-side; the bins in which the wanted ranks fall are cut
again until each holds a single value. What a round shuffles depends on the bins, never on a key's rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators.skew import HOT_ROWS, HOT_SHARE, null_safe

#: Bins of a round are 2 ** BIN_BITS for each key or open bin.
BIN_BITS = 14


def _encode(df: DataFrame, value: str) -> DataFrame:
    """Add `__u`, a bigint in the order of `value`; nulls and NaN are dropped, -0.0 is 0.0."""
    kind = df.schema[value].dataType
    c = F.col(value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        u = c.cast("bigint")
    elif isinstance(kind, T.DateType):
        u = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        u = F.unix_micros(c)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        @F.pandas_udf("bigint")
        def bits(x):  # a double's bits, negatives turned round, are in the order of the doubles
            import numpy as np
            import pandas as pd

            b = (x.to_numpy("float64") + 0.0).view("int64")
            return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b))

        df, u = df.where(~F.isnan(c)), bits(c.cast("double"))
    else:
        raise TypeError(f"{value}: no order statistics of {kind.simpleString()}")
    return df.where(c.isNotNull()).withColumn("__u", u)


def _decode(kind: T.DataType):
    u = F.col("__u")
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(u.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(u)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        @F.pandas_udf("double")
        def back(x):
            import numpy as np
            import pandas as pd

            b = x.to_numpy("int64")
            return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view("float64"))

        return back(u).cast(kind)
    return u.cast(kind)


def _select(rows: DataFrame, keys: list[str], targets: dict[tuple, list[int]], lo: int, hi: int) -> list[tuple]:
    """(key..., rank, value code, rows equal to it) for each wanted rank of each key; keys must be few."""
    spark = rows.sparkSession
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    shift = max(0, (int(hi) - int(lo)).bit_length() - BIN_BITS)
    found, open_bins, last = [], [(*k, None, r, r) for k, ranks in targets.items() for r in ranks], None
    while open_bins:
        schema = T.StructType([*kinds, T.StructField("__prefix", T.LongType()), T.StructField("__rank", T.LongType()), T.StructField("__rest", T.LongType())])
        want = spark.createDataFrame(open_bins, schema)
        active = F.broadcast(want.select(*keys, "__prefix").distinct())
        if last is None:
            inside = rows.join(active, null_safe(rows, active, keys), "left_semi").withColumn("__prefix", F.lit(None).cast("bigint"))
        else:
            cut = rows.withColumn("__prefix", F.shiftright("__u", last))
            inside = cut.join(active, null_safe(cut, active, [*keys, "__prefix"]), "left_semi")
        hist = inside.groupBy(*keys, "__prefix", F.shiftright("__u", shift).alias("__bin")).agg(F.count(F.lit(1)).alias("__c"), F.min("__u").alias("__min"), F.max("__u").alias("__max"))
        hist = hist.withColumn("__cum", F.sum("__c").over(Window.partitionBy(*keys, "__prefix").orderBy("__bin")))
        w = F.broadcast(want)
        hit = hist.join(w, null_safe(hist, w, [*keys, "__prefix"]) & (F.col("__rest") > F.col("__cum") - F.col("__c")) & (F.col("__rest") <= F.col("__cum")))
        got = hit.select(*[hist[k] for k in keys], "__rank", "__rest", "__bin", "__c", "__cum", "__min", "__max").collect()
        open_bins = []
        for r in got:
            *key, rank, rest, b, c, cum, least, most = r
            if least == most:
                found.append((*key, rank, least, c))
            else:
                open_bins.append((*key, b, rank, rest - (cum - c)))
        last, shift = shift, max(0, shift - BIN_BITS)
    return found


def per_key_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles of `value` for every key: columns keys, prob, rank, n, value, n_equal.

    The quantile of p is the value of rank ceil(p n) of n (the first at p = 0). Keys with at least
    max(share x rows, least) rows go through histogram refinement; the others, each with a bounded number of
    rows, through one grouped count. Null and NaN values don't count; a key without any other value has no
    row; a null key is a key. Ties and repeated rows count each. Other columns of `df` are ignored. An empty
    table gives an empty result.
    """
    kind = df.schema[value].dataType
    rows = _encode(df.select(*keys, value), value).select(*keys, "__u")
    spark = df.sparkSession
    floor = max(int(share * df.count()), least)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__u").alias("lo"), F.max("__u").alias("hi")).where(F.col("n") >= floor).collect()
    rank = lambda p, n: max(1, math.ceil(p * n - 1e-9))
    kinds = [T.StructField(k, df.schema[k].dataType) for k in keys]
    names = T.StructType([*kinds, *[T.StructField(x, t) for x, t in (("prob", T.DoubleType()), ("rank", T.LongType()), ("n", T.LongType()), ("__u", T.LongType()), ("n_equal", T.LongType()))]])
    cold, done = rows, None
    if hot:
        sizes = {tuple(r[k] for k in keys): r["n"] for r in hot}
        targets = {k: sorted({rank(p, n) for p in probs}) for k, n in sizes.items()}
        at = {(*x[:-3], x[-3]): x[-2:] for x in _select(rows, keys, targets, min(r["lo"] for r in hot), max(r["hi"] for r in hot))}
        done = spark.createDataFrame([(*k, float(p), rank(p, n), n, *at[(*k, rank(p, n))]) for k, n in sizes.items() for p in probs], names)
        few = F.broadcast(done.select(*keys).distinct())
        cold = rows.join(few, null_safe(rows, few, keys), "left_anti")
    each = cold.groupBy(*keys, "__u").agg(F.count(F.lit(1)).alias("n_equal"))
    all_of, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__u")
    each = each.withColumn("n", F.sum("n_equal").over(all_of)).withColumn("__cum", F.sum("n_equal").over(up_to))
    each = each.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    each = each.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n") - F.lit(1e-9))).cast("bigint"))
    each = each.where((F.col("rank") > F.col("__cum") - F.col("n_equal")) & (F.col("rank") <= F.col("__cum")))
    out = each.select(*keys, "prob", "rank", "n", "__u", "n_equal")
    if done is not None:
        out = out.unionByName(done)
    return out.select(*keys, "prob", "rank", "n", _decode(kind).alias(value), "n_equal")


def frequent_values(df: DataFrame, keys: list[str], value: str, share: float, total: int | None = None) -> list[tuple]:
    """(key..., value code, rows) of every value with at least share x total rows in its key.

    A value with so many rows covers one of the ranks s, 2s, ... where s = floor(share x total), so selecting
    those ranks finds them all; the keys must be few, their values may be any number. Total defaults to all
    rows of `df`. Nulls never count as a value. At most keys / share rows come back.
    """
    need = Fraction(str(share)) * (df.count() if total is None else total)
    step = max(1, math.floor(need))
    rows = _encode(df.select(*keys, value), value).select(*keys, "__u")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__u").alias("lo"), F.max("__u").alias("hi")).collect()
    if not sizes:
        return []
    targets = {tuple(r[k] for k in keys): list(range(step, r["n"] + 1, step)) for r in sizes}
    got = _select(rows, keys, targets, min(r["lo"] for r in sizes), max(r["hi"] for r in sizes))
    return sorted({(*x[:-3], x[-2], x[-1]) for x in got if x[-1] >= need})


def per_key_profile(df: DataFrame, key: str, partner: str, when: str, field: str) -> DataFrame:
    """Rows, distinct partners and least `when` of every key: columns `field`, n_rows, n_partners, first_when.

    Rows are first merged by (key, partner), which spreads a hot key over its partners and is merged map-side,
    then by key. Rows without a key are left out; rows without a partner count as rows only.
    """
    pairs = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(field), F.col(partner).alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.min(when).alias("__w"))
    return pairs.groupBy(field).agg(F.sum("__n").alias("n_rows"), F.count("__p").alias("n_partners"), F.min("__w").alias("first_when"))

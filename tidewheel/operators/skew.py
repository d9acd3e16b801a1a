"""Helpers that keep a few very frequent keys from holding up a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot from this share of the rows; so there are never more than 1 / HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 0.001
#: Rows that one task takes easily; smaller inputs have no hot keys.
HOT_ROWS = 200_000
#: Slices of a hot key.
SALTS = 32


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], total: int, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Keys that hold at least max(share x total, least) rows, with `n`. At most 1 / share rows, so it may be broadcast."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(int(share * total), least))


def skew_safe_left_join(big: DataFrame, small: DataFrame, keys: list[str], total: int | None = None, share: float = HOT_SHARE, least: int = HOT_ROWS, salts: int = SALTS, counted: DataFrame | None = None) -> DataFrame:
    """Left join where `small` has one row per key and `big` may have keys with any number of rows.

    The hot keys of `big` are counted with map-side aggregation; their rows are spread over `salts` slices,
    and only their (at most 1 / share) rows of `small` are repeated. Null keys match nothing, but are spread
    too. No row of either side is dropped. `counted`, if given, has the same keys as often as `big` and is cheaper to count.
    """
    total = big.count() if total is None else total
    if total < least:
        return big.join(small, keys, "left")
    hot = F.broadcast(hot_keys(big if counted is None else counted, keys, total, share, least).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))
    is_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    drop = [f"__h_{k}" for k in keys] + ["__hot"]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c, t in big.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts)).cast("int")
    b = big.join(hot, is_hot, "left").withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(0)).drop(*drop)
    s = small.join(hot, is_hot, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(*drop)
    return b.join(s, [*keys, "__salt"], "left").drop("__salt")


def prefix_sums(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of `value` over all earlier rows of the key, as `out`; the order is (`chunk`, `order`).

    `chunk` cuts each key into pieces that one task can sort; only one row per piece is looked at together.
    """
    pieces = df.groupBy(*keys, chunk).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, chunk, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(pieces, [*keys, chunk]).withColumn(out, F.col("__before") + F.col("__within")).drop("__before", "__within")

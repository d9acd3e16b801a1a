"""Continuous periods and gaps of overlapping day intervals (problem 4).

A mergeable aggregate: the state of an entity is a sorted list of disjoint day intervals. Every Arrow batch
is turned into such lists, lists are merged per (entity, slice), then per entity. Days are bounded, so a
list is bounded too (at most half of all days), however many rows its entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Day number that stands for an end that is open; later than any date.
OPEN = 4_000_000
#: Days of a stretch in which an entity's intervals are merged first; it holds at most half as many disjoint ones.
SLICE_DAYS = 1826


def merge_sorted(entity, start, end):
    """Disjoint sorted intervals of arrays that are ordered by (entity, start), entities as running numbers.

    Touching days count as one interval. One linear pass: a running maximum of the ends, offset by entity.
    """
    import numpy as np

    if not len(entity):
        return entity, start, end
    span = np.int64(OPEN) * 4
    reach = np.maximum.accumulate(entity * span + end)
    first = np.ones(len(entity), bool)
    first[1:] = (entity[1:] * span + start[1:]) > reach[:-1] + 1
    first[1:] |= entity[1:] != entity[:-1]
    at = np.flatnonzero(first)
    stop = np.append(at[1:], len(entity)) - 1
    return entity[at], start[at], reach[stop] - entity[at] * span


def _combine(frames: Iterator, keys: list[str]) -> Iterator:
    """Lists of each Arrow batch become one list per entity; consecutive sorted runs are merged by a stable sort (timsort), linear on runs."""
    import numpy as np
    import pandas as pd

    for f in frames:
        if f.empty:
            continue
        codes, _ = pd.factorize(pd.MultiIndex.from_frame(f[keys])) if len(keys) > 1 else pd.factorize(f[keys[0]])
        codes = codes.astype("int64")
        order = np.lexsort((f["__s"].to_numpy(), codes))
        e, s, t = merge_sorted(codes[order], f["__s"].to_numpy("int64")[order], f["__e"].to_numpy("int64")[order])
        row = pd.Series(np.arange(len(codes))).groupby(codes).first().to_numpy()
        out = f[keys].iloc[row[e]].reset_index(drop=True)
        out["__s"], out["__e"] = s, t
        yield out


def _stream_merge(frames: Iterator, keys: list[str]) -> Iterator:
    """Merge intervals that arrive ordered by (keys, start); only the last, still growing one is held back."""
    import numpy as np
    import pandas as pd

    held = None
    for f in frames:
        if held is not None:
            f = pd.concat([held, f], ignore_index=True)
        if f.empty:
            continue
        change = np.zeros(len(f), bool)
        for k in keys:
            v = f[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        codes = np.cumsum(change).astype("int64")
        e, s, t = merge_sorted(codes, f["__s"].to_numpy("int64"), f["__e"].to_numpy("int64"))
        row = np.append(0, np.flatnonzero(change))
        out = f[keys].iloc[row[e]].reset_index(drop=True)
        out["__s"], out["__e"] = s, t
        held = out.iloc[-1:].reset_index(drop=True)
        if len(out) > 1:
            yield out.iloc[:-1]
    if held is not None:
        yield held


def merged_intervals(df: DataFrame, entity: str, start: str, end: str, open_end: str | None = None) -> DataFrame:
    """Periods and the gaps between them: `entity`, kind ('period' or 'gap'), from_day date, to_day date, is_open.

    `start` and `end` are dates, both inclusive; where the boolean column `open_end` is true the end is open
    (to_day null, is_open true). Rows that overlap, share a day or follow on the next day become one period.
    Rows without entity or start, without an end that isn't open, or with the end before the start don't
    count. Repeated rows and nesting change nothing; no rows give no rows; other columns are ignored.
    """
    is_open = F.coalesce(F.col(open_end), F.lit(False)) if open_end else F.lit(False)
    kind = df.schema[entity].dataType.simpleString()
    rows = df.select(
        F.col(entity).alias("__k"),
        F.unix_date(start).cast("bigint").alias("__s"),
        F.when(is_open, F.lit(OPEN)).otherwise(F.unix_date(end)).cast("bigint").alias("__e"),
    ).where("__k is not null and __s is not null and __e >= __s")
    schema = f"__k {kind}, __s bigint, __e bigint"
    lists = rows.mapInPandas(lambda fs: _combine(fs, ["__k"]), schema)
    # the reduction tree: an entity's stretches of time first, so that its lists never meet in one task unmerged
    slices = lists.withColumn("__slice", F.floor(F.col("__s") / SLICE_DAYS).cast("int")).repartition("__k", "__slice")
    slices = slices.sortWithinPartitions("__k", "__slice", "__s", "__e").mapInPandas(lambda fs: _stream_merge(fs, ["__k", "__slice"]), f"__k {kind}, __slice int, __s bigint, __e bigint")
    whole = slices.select("__k", "__s", "__e").repartition("__k").sortWithinPartitions("__k", "__s", "__e").mapInPandas(lambda fs: _stream_merge(fs, ["__k"]), schema)
    # the complement: whole lists are disjoint, so each gap lies between a period and the next
    both = _with_next(whole, kind)
    return both.select(
        F.col("__k").alias(entity),
        "kind",
        F.date_from_unix_date(F.col("__s").cast("int")).alias("from_day"),
        F.when(F.col("__e") < OPEN, F.date_from_unix_date(F.when(F.col("__e") < OPEN, F.col("__e")).cast("int"))).alias("to_day"),
        (F.col("__e") >= OPEN).alias("is_open"),
    )


def _with_next(whole: DataFrame, kind: str) -> DataFrame:
    """Periods in order within a partition, followed by the gap to the next period of the same entity."""

    def emit(frames):
        import pandas as pd

        key, stop = None, None
        for f in frames:
            if f.empty:
                continue
            prev_k, prev_e = f["__k"].shift(1), f["__e"].shift(1)
            prev_k.iloc[0], prev_e.iloc[0] = key, stop
            gap = (f["__k"] == prev_k).to_numpy()
            gaps = pd.DataFrame({"__k": f["__k"][gap], "kind": "gap", "__s": prev_e[gap].astype("int64") + 1, "__e": f["__s"][gap] - 1})
            key, stop = f["__k"].iloc[-1], f["__e"].iloc[-1]
            yield pd.concat([f.assign(kind="period")[["__k", "kind", "__s", "__e"]], gaps], ignore_index=True)

    return whole.mapInPandas(emit, f"__k {kind}, kind string, __s bigint, __e bigint")

"""Top N items within every group by secondary sort (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.runs import codes, column, starts


def first_n(batches: Iterator, groups: list[str], items: list[str], n: int) -> Iterator:
    """Of batches sorted by group and rank, the first row of each group's first n different items.

    State is the last group's key and its at most n items. A batch is worked on as a whole: repeated items of a run are
    dropped and the others numbered.
    """
    import numpy as np
    import pyarrow as pa

    key, kept = None, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        start = starts(batch, groups)
        run, begin = np.cumsum(start) - 1, np.flatnonzero(start)
        group_cols, item_cols = ([column(batch, c) for c in names] for names in (groups, items))
        key_of = lambda row: [c.slice(int(row), 1) for c in group_cols]
        item_of = lambda row: tuple(c[int(row)].as_py() for c in item_cols)
        goes_on = key is not None and all(a.equals(b) for a, b in zip(key, key_of(0)))
        code = codes(item_cols, batch.num_rows)
        first = np.sort(np.unique(run * (int(code.max()) + 1) + code, return_index=True)[1])  # an item's first row in its run
        if goes_on:  # what is left of the group that began in an earlier batch
            more, mine = [], first[run[first] == 0] if len(kept) < n else ()
            for row in mine:
                if len(kept) == n:
                    break
                if (item := item_of(row)) not in kept:
                    kept.add(item)
                    more.append(row)
            first = first[run[first] > 0]
        place = np.arange(len(first)) - np.searchsorted(run[first], run[first])
        keep = first[place < n]
        last = len(begin) - 1
        if not goes_on or last > 0:
            key, kept = key_of(begin[last]), {item_of(row) for row in keep[run[keep] == last]}
        if goes_on and more:
            keep = np.concatenate([np.array(more), keep])
        if len(keep):
            yield batch.take(pa.array(keep))


def top_n(df: DataFrame, groups: list[str], order: list[Column], items: list[str], n: int) -> DataFrame:
    """The n best items of every group: one row each, the item's first in `order`, all if there are fewer.

    `order` must be total up to equal rows (end it with keys) so that ties are decided; an item that occurs
    again counts once, by its best row. Null groups and null items are values like others; put filters before.
    n < 1 or an empty table gives no rows. All columns are kept.

    First every input partition is sorted and streamed where it lies, which leaves at most n rows per group and
    partition; these are hash-partitioned by group, sorted, and streamed again. No group is ever held in memory,
    and a group of any size is cut down before it is moved.
    """
    if n < 1:
        return df.limit(0)
    schema, by = df.schema, [*[F.col(g) for g in groups], *order]

    def run(batches: Iterator) -> Iterator:
        return first_n(batches, groups, items, n)

    local = df.sortWithinPartitions(*by).mapInArrow(run, schema)
    return local.repartition(*groups).sortWithinPartitions(*by).mapInArrow(run, schema)

"""Mergeable distinct-count sketches with a known error bound (problem 5).

A sketch is one row per group with two columns of which one is set. `sparse` holds the 64-bit hashes of a small
set, sorted; its count is exact but for hash collisions. Beyond 2 ** precision / 32 hashes it becomes `dense`: a
byte per register with the greatest rank seen (the position of a hash's first one bit) and two indicator bits that tell
whether the two ranks below occurred, estimated by maximum likelihood. At equal error this takes about a quarter
less space than 6-bit registers of the greatest rank alone. Sketches merge without loss in any order and may be stored.

Rows are cut down to one sketch per group where they lie, so at most as many rows as tasks move for a group of any
size; sorted streams are folded, so a task holds one group's sketch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.runs import column, starts

#: Default precision: 2 ** 12 registers, relative standard error 1.2 %.
PRECISION = 12


def relative_error(precision: int) -> float:
    """Relative standard error of dense sketches: sqrt(4.63 / 8 / registers), as published for two indicator bits and 8-bit registers."""
    return (4.63 / 8 / 2**precision) ** 0.5


def sparse_limit(precision: int) -> int:
    """Hashes that a sketch keeps; they take at most a quarter of the registers' space."""
    return max(16, 2**precision // 32)


def _bit_length(x):
    """Bit lengths of an array of uint64."""
    import numpy as np

    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, np.frexp(high.astype("float64"))[1] + 32, np.frexp(low.astype("float64"))[1])


def registers(hashes, precision: int):
    """Registers (uint8, 0 where empty) of an array of hashes (int64)."""
    import numpy as np

    h = hashes.view("uint64")
    rank = np.minimum(65 - _bit_length(h << np.uint64(precision)), 65 - precision)
    seen = np.zeros(2**precision, "uint64")
    np.bitwise_or.at(seen, (h >> np.uint64(64 - precision)).astype("int64"), np.uint64(1) << (rank - 1).astype("uint64"))
    top = _bit_length(seen)
    two = (seen << np.uint64(2)) >> np.maximum(top - 1, 0).astype("uint64") & np.uint64(3)
    return np.where(top > 0, top * 4 + two.astype("int64"), 0).astype("uint8")


def union(a, b):
    """Registers of the union of two sets."""
    import numpy as np

    top = np.maximum(a >> 2, b >> 2)
    seen = np.zeros(len(a), "uint8")
    for r in (a, b):
        seen |= np.where(r > 0, 4 | (r & 3), 0).astype("uint8") >> np.minimum(top - (r >> 2), 3)
    return np.where(top > 0, top * 4 + (seen & 3), 0).astype("uint8")


class _Set:
    """A growing sketch."""

    def __init__(self, precision: int):
        self.precision, self.limit, self.dense = precision, sparse_limit(precision), None
        import numpy as np

        self.hashes = np.empty(0, "int64")

    def add(self, hashes=None, dense=None) -> None:
        import numpy as np

        if dense is not None:
            self.dense = dense if self.dense is None else union(self.dense, dense)
        if hashes is not None and len(hashes):
            self.hashes = np.union1d(self.hashes, hashes) if len(self.hashes) else np.unique(hashes)
        if len(self.hashes) and (self.dense is not None or len(self.hashes) > self.limit):
            own = registers(self.hashes, self.precision)
            self.dense = own if self.dense is None else union(self.dense, own)
            self.hashes = np.empty(0, "int64")


def _content(batch):
    """Hashes, the row of each, and {row: registers} of a batch of items' hashes (`__h`) or of sketches."""
    import numpy as np
    import pyarrow.compute as pc

    one = column(batch, "__h")
    if one is not None:
        rows = np.flatnonzero(one.is_valid().to_numpy(zero_copy_only=False))
        return one.drop_null().to_numpy(), rows, {}
    sparse, dense = column(batch, "sparse"), column(batch, "dense")
    lengths = pc.fill_null(pc.list_value_length(sparse), 0).to_numpy(zero_copy_only=False)
    packed = np.flatnonzero(dense.is_valid().to_numpy(zero_copy_only=False))
    return sparse.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths), {int(i): np.frombuffer(dense[int(i)].as_buffer(), "uint8") for i in packed}


def fold(batches: Iterator, groups: list[str], precision: int) -> Iterator:
    """One sketch per run of equal groups of a sorted stream of hashes or sketches."""
    import numpy as np
    import pyarrow as pa

    limit, key, state = sparse_limit(precision), None, None
    empty = np.empty(0, "int64")

    def rows(keys, hashes, ends, packed: dict):
        absent = np.zeros(len(ends) - 1, bool)
        absent[list(packed)] = True
        sparse = pa.ListArray.from_arrays(pa.array(ends.astype("int32"), mask=np.append(absent, False)), pa.array(hashes))
        dense = pa.array([packed[i].tobytes() if absent[i] else None for i in range(len(absent))] if packed else [None] * len(absent), pa.binary())
        return pa.RecordBatch.from_arrays([*keys, sparse, dense], names=[*groups, "sparse", "dense"])

    def closed():
        packed = {} if state.dense is None else {0: state.dense}
        return rows(key, state.hashes, np.array([0, len(state.hashes)]), packed)

    for batch in batches:
        if not batch.num_rows:
            continue
        start = starts(batch, groups)
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        hashes, row, packed = _content(batch)
        of = run[row]
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, of = hashes[new], of[new]
        count = np.bincount(of, minlength=len(first))
        ends = np.concatenate([[0], np.cumsum(count)])
        columns = [column(batch, g) for g in groups]
        key_at = lambda i: [c.slice(int(first[i]), 1) for c in columns]
        dense: dict[int, object] = {}
        for i, r in packed.items():
            at = int(run[i])
            dense[at] = union(dense[at], r) if at in dense else r
        part = lambda i: hashes[ends[i] : ends[i + 1]]
        begin = 0
        if state is not None:
            if all(a.equals(b) for a, b in zip(key, key_at(0))):
                state.add(part(0), dense.get(0))
                begin = 1
            if begin == 0 or len(first) > 1:
                yield closed()
                state = None
        last = len(first) - 1
        if last >= begin:
            if last > begin:  # runs that begin and end here
                full = {i - begin: _dense(part(i), dense.get(i), precision) for i in {*np.flatnonzero(count > limit).tolist(), *dense} if begin <= i < last}
                kept = np.array([0 if i - begin in full else count[i] for i in range(begin, last)]) if full else count[begin:last]
                body = hashes[ends[begin] : ends[last]]
                if full:
                    body = body[np.isin(of[ends[begin] : ends[last]] - begin, list(full), invert=True)]
                yield rows([c.take(pa.array(first[begin:last])) for c in columns], body, np.concatenate([[0], np.cumsum(kept)]), full)
            key, state = key_at(last), _Set(precision)
            state.add(part(last), dense.get(last))
    if state is not None:
        yield closed()


def _dense(hashes, have, precision: int):
    own = registers(hashes, precision)
    return own if have is None else union(own, have)


def _fields(df: DataFrame, groups: list[str]) -> str:
    return "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in groups)


def _folded(df: DataFrame, groups: list[str], precision: int) -> DataFrame:
    schema = f"{_fields(df, groups)}sparse array<bigint>, dense binary"
    ordered = df.sortWithinPartitions(*groups) if groups else df
    return ordered.mapInArrow(lambda batches: fold(batches, groups, precision), schema)


def partial_sketches(df: DataFrame, groups: list[str], item: Column | str, precision: int = PRECISION) -> DataFrame:
    """A sketch of each group and input partition; no shuffle. Null items don't count; a group with only such is empty."""
    item = F.col(item) if isinstance(item, str) else item
    rows = df.select(*groups, F.when(item.isNotNull(), F.xxhash64(item)).alias("__h"))
    return _folded(rows, groups, precision)


def merge(sketches: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """Union of sketches by (coarser) groups, exactly the sketch of the united rows; order and repeats don't matter.

    Sketches of a group are cut down to one per input partition before they move.
    """
    local = _folded(sketches.select(*groups, "sparse", "dense"), groups, precision)
    return _folded(local.repartition(*groups) if groups else local.repartition(1), groups, precision)


def sketch(df: DataFrame, groups: list[str], item: Column | str, precision: int = PRECISION) -> DataFrame:
    """groups, sparse, dense: the sketch of the items of each group. Null groups are groups; an empty table has none."""
    parts = partial_sketches(df, groups, item, precision)
    return _folded(parts.repartition(*groups) if groups else parts.repartition(1), groups, precision)


def likelihood_estimate(counts, precision: int):
    """Maximum-likelihood counts from an array (n, 256) of how many registers hold each value."""
    import numpy as np

    m, most = 2**precision, 65 - precision
    prob = 0.5 ** np.arange(1, most + 1)
    prob[-1] = 0.5 ** (most - 1)
    absent = m - counts.sum(axis=1).astype(float)  # their whole probability was missed
    seen = np.zeros((len(counts), most))
    missed = absent.copy()
    for value in np.flatnonzero(counts.any(axis=0)):
        top, two = int(value) >> 2, int(value) & 3
        c = counts[:, value]
        seen[:, top - 1] += c
        missed += c * (prob[top:].sum() if top < most else 0.0)
        for below, bit in ((top - 2, two >> 1), (top - 3, two & 1)):
            if below >= 0:
                if bit:
                    seen[:, below] += c
                else:
                    missed += c * prob[below]
    low, high = np.full(len(counts), -30.0), np.full(len(counts), 45.0)  # logs of the rate per register
    for _ in range(60):
        mid = (low + high) / 2
        x = np.exp(mid)[:, None] * prob
        with np.errstate(over="ignore"):
            slope = (seen * prob / np.expm1(np.minimum(x, 700))).sum(axis=1) - missed
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    out = m * np.exp((low + high) / 2) / (1 + 0.48147 / m)
    return np.where(counts.sum(axis=1) == 0, 0.0, out)


def _of_registers(arrays: list, precision: int):
    """Estimates of a list of register arrays."""
    import numpy as np

    out = []
    for at in range(0, len(arrays), 512):
        counts = np.array([np.bincount(r, minlength=256) for r in arrays[at : at + 512]])
        counts[:, 0] = 0
        out.append(likelihood_estimate(counts, precision))
    return np.concatenate(out) if out else np.empty(0)


def estimate(sketches: DataFrame, groups: list[str], precision: int = PRECISION, sigmas: float = 3.0) -> DataFrame:
    """groups, estimate, low, high (`sigmas` standard errors either way) and `exact` (the sketch was sparse: low = high)."""
    error = sigmas * relative_error(precision)

    def solve(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            _, _, packed = _content(batch)
            value = pc.fill_null(pc.list_value_length(column(batch, "sparse")), 0).to_numpy(zero_copy_only=False).astype("float64")
            exact = np.ones(len(value), bool)
            if packed:
                at = np.array(list(packed))
                value[at], exact[at] = _of_registers(list(packed.values()), precision), False
            low, high = np.where(exact, value, value / (1 + error)), np.where(exact, value, value * (1 + error))
            yield pa.RecordBatch.from_arrays([*[column(batch, g) for g in groups], *[pa.array(x) for x in (value, low, high, exact)]], names=[*groups, "estimate", "low", "high", "exact"])

    return sketches.select(*groups, "sparse", "dense").mapInArrow(solve, f"{_fields(sketches, groups)}estimate double, low double, high double, exact boolean")


def running_counts(sketches: DataFrame, group: str, step: str, precision: int = PRECISION) -> DataFrame:
    """group, step, estimate, exact: distinct items of each group up to each of its steps, from sketches of (group, step).

    Partitioned by group, sorted by step, streamed: a task holds the union of one group's sketches.
    """
    schema = f"{_fields(sketches, [group, step])}estimate double, exact boolean"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, row, packed = _content(batch)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            start, keys = starts(batch, [group]), column(batch, group)
            value, exact, full = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool), {}
            for i in range(batch.num_rows):
                if start[i] and (i > 0 or key is None or not keys.slice(0, 1).equals(key)):
                    state = _Set(precision)
                state.add(hashes[ends[i] : ends[i + 1]], packed.get(i))
                if state.dense is None:
                    value[i] = len(state.hashes)
                else:
                    full[i] = state.dense
            if full:
                at = list(full)
                value[at], exact[at] = _of_registers(list(full.values()), precision), False
            key = keys.slice(batch.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([keys, column(batch, step), pa.array(value), pa.array(exact)], names=[group, step, "estimate", "exact"])

    return sketches.select(group, step, "sparse", "dense").repartition(group).sortWithinPartitions(group, step).mapInArrow(run, schema)

"""Runs of equal groups in sorted Arrow batches."""

from __future__ import annotations


def column(batch, name: str):
    """Column of that name, or None."""
    i = batch.schema.get_field_index(name)
    return None if i < 0 else batch.column(i)


def starts(batch, groups: list[str]):
    """Mask of the rows whose group differs from that of the row before, null equal to null; the first row is one."""
    import numpy as np
    import pyarrow.compute as pc

    start = np.zeros(batch.num_rows, bool)
    start[0] = True
    for g in groups:
        c = column(batch, g)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        start[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        start[1:] |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return start


def codes(columns: list, size: int):
    """A number for every row, the same for rows that are equal in all columns."""
    import numpy as np
    import pyarrow.compute as pc

    code = np.zeros(size, "int64")
    for c in columns:
        d = pc.dictionary_encode(c, null_encoding="encode")
        code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code

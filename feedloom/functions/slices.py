"""Python functions over the rows of an Arrow batch, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Rows whose values are Python objects at once.
SLICE = 64


def by_slices(read: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """`read` for every row.

    A batch holds as many rows as the session allows (10,000 unless it is told otherwise).  As Python objects its texts
    and answers take several times their bytes, so only those of one slice are held; the rest are Arrow buffers.
    """
    parts = [
        pa.array([read(*row) for row in zip(*[c.slice(start, SLICE).to_pylist() for c in columns])], kind)
        for start in range(0, len(columns[0]), SLICE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)

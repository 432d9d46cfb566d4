"""What a Python worker holds at once."""

from __future__ import annotations

import pyarrow as pa
import pytest

from feedloom.functions import slices


class Rows:
    """A column that notes how many of its rows were asked for at once."""

    def __init__(self, n):
        self.n, self.asked = n, []

    def __len__(self):
        return self.n

    def slice(self, start, n):
        self.asked.append(n)
        return pa.array([str(i) for i in range(start, min(self.n, start + n))])


@pytest.mark.parametrize("n", [0, 1, 64, 65, 1000])
def test_a_batch_is_read_in_slices(n):
    rows = Rows(n)
    assert slices.by_slices(lambda v: v + "!", pa.string(), rows).to_pylist() == [f"{i}!" for i in range(n)]
    assert all(asked <= slices.SLICE for asked in rows.asked)

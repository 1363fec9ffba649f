"""Arrow batches by bytes: what a task holds as Python objects doesn't grow with the number of rows that Spark sends at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of values that make a batch full.
FULL = 4 << 20


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The values of one row after the other."""
    for row in zip(*batch.columns):
        yield tuple(x.as_py() for x in row)


def parted(values: Iterable, size: Callable[..., int], full: int = FULL) -> Iterator[list]:
    """Lists of successive values, each ended by the value that brings its sizes to ``full``."""
    some, held = [], 0
    for value in values:
        some.append(value)
        held += size(value)
        if held >= full:
            yield some
            some, held = [], 0
    if some:
        yield some

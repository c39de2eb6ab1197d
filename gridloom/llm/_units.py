"""Texts as runs of short units, each distinct unit looked at once a slice.

Arrow splits a slice of texts and encodes the units as a dictionary; what is computed for the
distinct units is then spread over all of them by index. Slices hold a bounded number of bytes (or
one text), memos a bounded number of units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of at most so many bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def encoded(split: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of a list array without nulls: units in each list, the distinct units, the index of each unit."""
    flat = split.flatten().dictionary_encode()
    return np.diff(split.offsets.to_numpy()).astype(np.int64), flat.dictionary, flat.indices.to_numpy()


class Memo:
    """What f(list of units) gives for each, remembered for some ``most`` units; then it starts afresh."""

    def __init__(self, f: Callable[[list], list], most: int = 400_000):
        self.f, self.most, self.known = f, most, {}

    def all(self, units: list) -> list:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = [u for u in units if u not in known]
        if new:
            known.update(zip(new, self.f(new)))
        return [known[u] for u in units]


def gather(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values holds a run of sizes[i] for each i: the runs of index one after another, and their sizes."""
    starts, n = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.cumsum(n)
    return values[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def spread(parts: list[bytes], index: np.ndarray, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """gather of the values that parts hold as bytes."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    return gather(np.frombuffer(b"".join(parts), dtype=kind), sizes, index)


def totals(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (zero: 0)."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]

"""Vectorised views of a batch of texts: bytes, words, hashes.  Everything here works inside one Arrow task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and each text's offsets in them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, each with its flat bytes and offsets, of about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ``[\\x20\\x09-\\x0D]``, and where each text's words begin."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Polynomial hashes of any span of a chunk from its prefix sums, modulo 2**64, then mixed."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if 0 not in self._powers or len(self._powers[0][0]) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            tables = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                tables.append(np.multiply.accumulate(p))
            self._powers[0] = (tables[0], tables[1])
        self.up, self.down = self._powers[0]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_SYMBOL[data] * self.up[: n - 1], out=self.sums[1:])
        if n > CHUNK_BYTES * 4:  # one huge text's tables aren't kept for the rest of the task
            self._powers.clear()

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed: equal spans of one length agree, wherever they stand."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

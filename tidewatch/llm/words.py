"""Words and windows of Arrow text columns as numpy arrays, without a Python object per word.

A block is a run of rows with about a megabyte of text (one longer text is a block of its own), so what a
task holds beside its Arrow batch is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(seed * 0x1000003 + 1)
    return mix64(steps) | np.uint64(1)


_BYTE_CODES = constants(11, 256)
_powers = {1: np.ones(1, dtype=np.uint64), -1: np.ones(1, dtype=np.uint64)}


def _power_table(direction: int, n: int) -> np.ndarray:
    if len(_powers[direction]) < n:
        base = np.full(max(n, BLOCK_BYTES + 1), _MULTIPLIER if direction == 1 else _INVERSE, dtype=np.uint64)
        base[0] = 1
        _powers[direction] = np.cumprod(base, dtype=np.uint64)
    return _powers[direction][:n]


def text_blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, row bounds) for slices of a batch; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first), data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


class Words:
    """The words of a block: where each starts and ends (bytes), its hash, and each row's first word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        solid = ~IS_BLANK[data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        if len(data):
            before[1:], after[:-1] = solid[:-1], solid[1:]
            before[bounds[:-1][bounds[:-1] < len(data)]] = False
            after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        codes = _BYTE_CODES[data] * _power_table(1, len(data))
        codes[~solid] = 0
        if len(self.starts):
            sums = np.add.reduceat(codes, self.starts) * _power_table(-1, len(data))[self.starts]
            self.hashes = mix64(sums + (self.ends - self.starts).astype(np.uint64))
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every run of ``size`` words inside one row."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1:])
        total = np.zeros(len(at), dtype=np.uint64)
        for j, factor in enumerate(constants(23, size)):
            total += self.hashes[at + j] * factor
        return at, mix64(total)

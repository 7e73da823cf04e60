"""Vectorised text kernels over Arrow buffers.

A *block* is a run of documents held as one byte buffer plus offsets. Words are maximal
runs of bytes outside ``[\\x20\\x09-\\x0D]``, which on UTF-8 equals the same rule on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
_C = ctypes.CDLL(None)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK_BYTES + 1), base & _MASK, np.uint64)
        out[0] = 1
        have = np.cumprod(out)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def trim() -> None:
    """Give back memory that a task no longer holds; its worker, which serves further tasks, would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def as_text(column: pa.Array) -> pa.Array:
    """Null texts are empty; the result is a plain string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first offset 0) of a string or binary array."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into pieces of about ``size`` text bytes (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = as_text(batch.column(batch.schema.get_field_index(text)))
        _, off = buffers(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            buf, part = buffers(column.slice(at, to - at))
            yield batch.slice(at, to - at), buf, part
            at = to
    trim()


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = 2 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` bytes in column ``text``, so that Python objects made from them stay few."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(off, int(off[at]) + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


class Words:
    """Words of a block: ``start``, ``end`` (bytes), ``doc`` (index in block), ``count`` per document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        inside = ~SPACE[buf]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin, stop = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
        first[begin], last[stop] = inside[begin], inside[stop]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, off)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, family: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, family)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of ascending byte spans, from running polynomial sums."""
    out = np.empty(len(start), np.uint64)
    table = _BYTE[family]
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + BLOCK_BYTES, "right")))
        hi = int(end[j - 1])
        up, down = _powers(_BASE, hi - lo + 1), _powers(_INVERSE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * up[:-1], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def raw_windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, also those that cross documents."""
    m = max(0, len(h) - n + 1)
    acc = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        acc *= _STEP
        acc += h[k : m + k]
    return mix(acc)


def places(bounds: np.ndarray, n: int) -> np.ndarray:
    """First words of the runs of ``n`` words that lie within one document."""
    count = np.diff(bounds)
    keep = np.repeat(count >= n, count)
    late = bounds[1:][count >= n]
    for k in range(1, n):
        keep[late - k] = False
    return np.flatnonzero(keep)


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        if len(x) <= step:
            return x[:0]
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` words that lie within one document, and their first words' places."""
    at = places(bounds, n)
    return raw_windows(h, n)[at], at


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binary_array(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def complete_runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Tables from sorted batches that end where the first ``keys`` columns change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(cols))
        cut = np.flatnonzero(change)
        if len(cut):
            at = int(cut[-1])
            ready = [*held, batch.slice(0, at)]
            if any(b.num_rows for b in ready):
                yield pa.Table.from_batches(ready).combine_chunks()
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held.clear()
    trim()


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new

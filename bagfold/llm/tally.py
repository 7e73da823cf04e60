"""Corpus counts of 64-bit keys, and sums over rows of what a table says about their keys.

Counts leave a task packed, one row for each bucket of keys. Lookups go by a list of the most frequent keys, which is broadcast and has a fixed
length; the keys beyond it, of which none is frequent, are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import binary_array, buffers, mix, pieces, run_starts, trim

COUNTS = "bucket int, keys binary, counts binary"
#: Keys that a task holds before it hands their counts on.
COUNT_ROWS = 4_000_000
#: Classes of counts for each doubling.
CLASSES = 16


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys (sorted as signed numbers) and their summed counts."""
    key, count = np.concatenate(keys).view(np.int64), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(run_starts(key)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count[:0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands there."""
    ordered = np.sort(keys)
    first = np.flatnonzero(run_starts(ordered)) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """COUNTS: a row for each bucket that has keys."""
    bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, key, count = bucket[order], keys[order], counts[order].astype(np.int64)
    lead = np.flatnonzero(run_starts(bucket)) if len(bucket) else np.zeros(0, np.int64)
    off = np.append(lead, len(bucket)) * 8
    return pa.RecordBatch.from_arrays([pa.array(bucket[lead].astype(np.int32)), *(binary_array(np.ascontiguousarray(x).view(np.uint8), off) for x in (key, count))], names=["bucket", "keys", "counts"])


class Tally:
    """Counts of a task: ``add`` gives packed rows when much is held, ``close`` the rest."""

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.counts, self.rows, self.most = buckets, [], [], 0, COUNT_ROWS

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys.view(np.int64))
        self.counts.append(counts)
        self.rows += len(keys)
        if self.rows >= self.most:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield packed(*summed(self.keys, self.counts), self.buckets)
        self.keys, self.counts, self.rows = [], [], 0


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) from packed counts; the keys of a bucket are in no other task."""
    keys, counts, rows, most = [], [], 0, COUNT_ROWS
    for batch in batches:
        for k, n in zip(batch.column(0), batch.column(1), strict=True):
            keys.append(np.frombuffer(k.as_buffer(), np.int64))
            counts.append(np.frombuffer(n.as_buffer(), np.int64))
            rows += len(keys[-1])
        if rows >= most:
            key, count = summed(keys, counts)
            keys, counts, rows, most = [key], [count], len(key), max(COUNT_ROWS, 2 * len(key))
    if rows:
        key, count = summed(keys, counts)
        for at in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 18)]), pa.array(count[at : at + (1 << 18)])], names=["key", "n"])
    trim()


def totals(counts: DataFrame, width: int) -> DataFrame:
    """(key, n) of COUNTS rows made for ``width`` buckets."""
    return counts.repartitionById(width, "bucket").select("keys", "counts").mapInArrow(_sums, "key long, n long")


def _class() -> Column:
    return F.floor(CLASSES * F.log2("n")).cast("long")


def frequent(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows of ``table`` (written, with ``n``) of the largest counts, at most ``most`` of them, cut at a class of counts; and whether these are all."""
    left, least, every = most, None, True
    for r in sorted(table.groupBy(_class().alias("c")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.c):
        if r.rows > left:
            every = False
            break
        left, least = left - r.rows, r.c
    return (table.limit(0) if least is None else table.filter(_class() >= least)), every


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1, 1 << 20):
        raw, off = buffers(batch.column(1))
        key, row = np.frombuffer(raw.tobytes(), np.int64), np.repeat(np.arange(batch.num_rows), np.diff(off) // 8)
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        first = np.flatnonzero(run_starts(row, key))
        rid, key, times = batch.column(0).to_numpy()[row[first]], key[first], np.diff(np.append(first, len(key)))
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (rid, key, times)], names=["rid", "key", "times"])


def rest_sums(rows: DataFrame, table: DataFrame, *values: str) -> DataFrame:
    """(rid, values): sums of ``values`` of ``table`` (key, values) over the keys in ``rest`` of ``rows`` (rid, rest: packed 64-bit keys). Keys that the table lacks add nothing."""
    some = rows.filter(F.length("rest") > 0).select("rid", "rest").mapInArrow(_each, "rid long, key long, times long")
    return some.join(table.select("key", *values), "key").groupBy("rid").agg(*[F.sum(F.col(v) * F.col("times")).alias(v) for v in values])

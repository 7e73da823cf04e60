"""Improbable-feature digests and their likeness.

Every window of ``FEATURE`` bytes has an entropy class; a class is the rarer, the fewer windows of the whole corpus are in it. In each
run of ``RUN`` neighbouring windows the rarest (leftmost) one scores; windows with ``POPULAR`` scores are a text's features. Their
hashes fill a chain of Bloom filters of 2048 bits, ``PER_FILTER`` features each. Two digests are compared filter by filter: overlap of bits,
normalised between what chance gives and what the emptier filter allows, best partner for each, averaged by
features over the shorter chain.

Classes of least entropy (long repeats of one byte) are taken only where a text has nothing else. A text shorter than a window is one
feature; the empty text has the empty digest, equal to itself alone.

Documents follow each other by doc_id (null first, then text hash); the last is followed by the first. Rows are dealt into ranges, each with a copy of
the first row of the next, so that no range needs another. Repeated rows follow one another. Other columns pass by;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shuffle_width, ship
from .kernel import as_text, blocks, pieces, slide_min, span_hashes
from .lines import doc_key
from .substring import unsqueeze

FEATURE, RUN, POPULAR = 64, 64, 16
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
CLASSES = 1001
#: Classes from here on (under 0.6 bits a byte) are weak; CHANCE is the share of the normalised range that counts as none.
WEAK, CHANCE = 900, 0.05
#: Bytes handled at once; the 63 passes over them stay in the cache.
SPAN_BYTES = 1 << 18

_C = np.arange(FEATURE + 1)
_F = np.round(1000 * _C * np.log2(np.maximum(_C, 1))).astype(np.int64)
_G = np.diff(_F)
_SCALE = int(_F[FEATURE])


def entropy_classes(buf: np.ndarray) -> np.ndarray:
    """Class of every window of the buffer, 0 (most entropy) to 1000.

    With c[b] of byte b in a window its entropy is 6 - sum(c log2 c) / 64. A byte that enters or leaves changes the sum by a function of how often it is in
    the other 63 places, which 63 shifted comparisons count.
    """
    n = len(buf)
    if n < FEATURE:
        return np.zeros(0, np.int64)
    before, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(n, bool)
    for d in range(1, FEATURE):
        eq = same[: n - d]
        np.equal(buf[d:], buf[:-d], out=eq)
        flag = eq.view(np.uint8)
        before[d:] += flag
        behind[:-d] += flag
    enter = np.cumsum(_G[before])
    leave = np.cumsum(_G[behind])
    total = enter[FEATURE - 1 :].copy()
    total[1:] -= leave[: n - FEATURE]
    return total * (CLASSES - 1) // _SCALE


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(CLASSES, np.int64)
    for _, buf, off in blocks(batches, size=SPAN_BYTES):
        cls = entropy_classes(buf)
        inside = np.zeros(len(cls) + 1, np.int64)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= FEATURE:
                inside[a] += 1
                inside[b - FEATURE + 1] -= 1
        count += np.bincount(cls[np.cumsum(inside[:-1]) > 0], minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(count)], names=["class", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each class, rarest first; from all windows of all documents."""
    ship(docs.sparkSession)
    table = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(class_counts, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CLASSES, np.int64)
    n[table.column(0).to_numpy()] = table.column(1).to_numpy()
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), n))] = np.arange(CLASSES)
    rank[WEAK:] += CLASSES
    return rank


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Chains of filters (uint8, filters x 256) of the texts."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, doc = [], [], []
    cls = entropy_classes(buf)
    ranks = rank[cls]
    key = (ranks << 32) | np.arange(len(ranks))
    least = slide_min(key, RUN) & 0xFFFFFFFF
    size = np.diff(off) - FEATURE + 1  # windows of each text
    runs = size - RUN + 1
    long = np.flatnonzero(runs > 0)
    if len(long):
        at = np.repeat(off[long] - np.concatenate([[0], np.cumsum(runs[long])[:-1]]), runs[long]) + np.arange(int(runs[long].sum()))
        score = np.bincount(least[at], minlength=len(ranks))
        picked = np.flatnonzero((score >= POPULAR) & (ranks < CLASSES))
        owner = np.searchsorted(off, picked, "right") - 1
        lone = np.setdiff1d(long, owner)
        start.append(picked)
        doc.append(owner)
    else:
        lone = np.zeros(0, np.int64)
    one = [(int(i), int(off[i] + key[off[i] : off[i] + size[i]].argmin())) for i in np.concatenate([lone, np.flatnonzero((size > 0) & (runs <= 0))]).tolist()]
    start.append(np.array([p for _, p in one], np.int64))
    doc.append(np.array([i for i, _ in one], np.int64))
    start, doc = np.concatenate(start), np.concatenate(doc)
    end = start + FEATURE
    short = np.flatnonzero((size <= 0) & (off[1:] > off[:-1]))
    start, end, doc = np.concatenate([start, off[short]]), np.concatenate([end, off[short + 1]]), np.concatenate([doc, short])
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], end[order], doc[order]
    h = span_hashes(buf, start, end)
    # the first of equal features of a text counts, in order of place
    _, first = np.unique(np.stack([doc.astype(np.uint64), h], 1), axis=0, return_index=True)
    first.sort()
    h, doc = h[first], doc[first]
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    count = np.diff(begin)
    chains = -(-count // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chains)])
    row = base[doc] + (np.arange(len(doc)) - begin[doc]) // PER_FILTER
    bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(12 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 (no more than chance) to 1 (equal) for two chains."""
    if len(x) > len(y) or (len(x) == len(y) and x.tobytes() > y.tobytes()):
        x, y = y, x
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if x.shape == y.shape and (x == y).all():
        return 1.0
    a, b = x.view(np.uint64), y.view(np.uint64)
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for i in range(len(a)):  # one filter against the other chain
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        most = np.minimum(na[i], nb)
        chance = na[i] * nb / FILTER_BITS
        none = chance + CHANCE * (most - chance)
        best[i] = np.clip((both - none) / np.maximum(most - none, 1e-9), 0, 1).max()
    return float((best * na).sum() / na.sum())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _deal(bounds: list[tuple[int, int]]):
    first = {b: i for i, b in enumerate(bounds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, 3):  # did, th, doc_id, text
            bucket, tail, take = [], [], []
            blob = [packer.compress(t.as_buffer()) for t in as_text(batch.column(3))]
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                bucket.append(max(0, bisect.bisect_right(bounds, key) - 1))
                tail.append(False)
                take.append(i)
                if (b := first.get(key)) is not None:  # also the last row of the range before
                    bucket.append((b - 1) % len(bounds))
                    tail.append(True)
                    take.append(i)
            at = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(tail), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(blob, pa.binary()).take(at)], names=["bucket", "tail", "did", "th", "doc_id", "blob"])

    return run


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint(rank):
    def close(rows: list[tuple[object, str]]) -> pa.RecordBatch:
        """Rows are followed by one more that is not reported."""
        texts = [t for _, t in rows]
        changed = [edited(t, n) for t, n in zip(texts[:-1], texts[1:], strict=True)]
        made = digests([t.encode() for t in texts + changed], rank.value)
        own, other = made[: len(texts)], made[len(texts) :]
        text = [base64.b64encode(x.tobytes()).decode() for x in made]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(text[: len(texts) - 1], pa.string()),
                pa.array(text[len(texts) :], pa.string()),
                pa.array([likeness(x, y) for x, y in zip(own[:-1], other, strict=True)], pa.float64()),
                pa.array([likeness(x, y) for x, y in zip(own[:-1], own[1:], strict=True)], pa.float64()),
            ],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now, done = [], 0, None, False
        for batch in batches:  # bucket, tail, doc_id, blob
            for bucket, tail, doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if bucket != now:
                    rows, size, now, done = [], 0, bucket, False
                if done:
                    continue
                text = unsqueeze(blob).decode()
                rows.append((doc_id, text))
                size += len(text)
                if tail or size >= SPAN_BYTES and len(rows) > 1:
                    yield close(rows)
                    rows, size, done = rows[-1:], len(rows[-1][1]), tail

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT: digests of every text and of its edited form, and their likeness."""
    spark = docs.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    rows = docs.select(*doc_key(doc_id, text), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keys = rows.select("did", "th").repartitionByRange(width, "did", "th").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("did", "th")).alias("k"))
    bounds = sorted((r.k.did, r.k.th) for r in keys.collect())  # one row a range
    rank = spark.sparkContext.broadcast(rarity(docs, text))
    if not bounds:
        return spark.createDataFrame([], RESULT)
    dealt = rows.mapInArrow(_deal(bounds), "bucket int, tail boolean, did long, th long, doc_id long, blob binary")
    dealt = dealt.repartitionById(width, "bucket").sortWithinPartitions("bucket", "tail", "did", "th").select("bucket", "tail", "doc_id", "blob")
    return dealt.mapInArrow(_fingerprint(rank), RESULT)


def op6_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

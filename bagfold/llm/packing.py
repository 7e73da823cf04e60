"""Sum-of-squares packing of token sequences.

Every document is encoded whole and ends with one end token; longer ones than a sequence are cut into full pieces, the first may be
shorter. Full pieces are sequences of their own. The others are dealt into groups of about ``GROUP`` pieces, which pack apart:
a group holds the number of open bins for each residual gap, and each piece, longest first, goes to the gap
for which the sum of the squared counts becomes smallest (the tightest gap on ties); a new bin opens only where no open one fits.
A group leaves a few bins open, whatever their number in all, so the waste stays a fixed small share.

Nulls and defects: a null text is empty and is one end token. Repeated rows are packed each. Other columns pass by;
an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .kernel import complete_runs, pieces

CAPACITY, END, GROUP = 1024, 2, 16384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes and id of each token of a byte-level BPE file of the ``tokenizers`` library, and its added tokens.

    Such files write a byte as one character: itself where it is visible, else the next of those from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in or ask for what is around them")
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}, added


def encoder(path: str, pattern: str):
    """The ids that the ``tokenizers`` library gives, from an engine that is several times as fast on the same vocabulary.

    Ids of such a vocabulary are in order of merges, so they are its ranks. A test compares both on every code point. As by the
    library's default, the file's added tokens are cut from a text where ``allowed_special`` is "all"; without it they are plain text.
    """
    import tiktoken

    ranks, added = vocabulary(path)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added).encode_to_numpy


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, pattern: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path, pattern), np.array([end], "<u4").tobytes()
        for batch in pieces(batches, 1):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "", allowed_special="all").astype("<u4").tobytes() + last
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        # moving a bin from gap g to g - s changes the sum of squares by 2 (n[g - s] - n[g]) + 2, or by 1 - 2 n[g] when it closes
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        if len(change):
            change[0] = 1 - 2 * count[s]
            change[count[s:capacity] == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
        if len(change) and count[s + k]:
            b = open_[s + k].pop()
            count[s + k] -= 1
            at[i] = capacity - s - k
        else:
            b, k = used, capacity - s
            used += 1
        bins[i] = b
        if k:
            open_[k].append(b)
            count[k] += 1
    return bins, at


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches):  # group, then PIECES, sorted by group and falling length
            group, length = table.column(0).to_numpy(), table.column(4).to_numpy()
            edge = np.flatnonzero(np.diff(group, prepend=group[:1] - 1, append=group[-1:] + 1))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                bins, at = sum_of_squares(length[lo:hi], capacity)
                part = table.slice(lo, hi - lo).drop_columns("group").append_column("sequence_id", pa.array(bins + (int(group[lo]) << 24))).append_column("offset", pa.array(at))
                yield from part.combine_chunks().to_batches()

    return run


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their sequence and offset. A group of at most 2**24 pieces owns a range of sequence numbers."""
    spark = docs.sparkSession
    ship(spark)
    found = materialize(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_pieces(path, pattern, capacity, end), PIECES), "pieces")
    full = found.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = found.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))
    dealt = part.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).alias("group"), "*")
    dealt = dealt.repartitionByRange(min(groups, 16 * shuffle_width(spark)), "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece")
    return full.unionByName(dealt.mapInArrow(_pack(capacity), PLACED))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

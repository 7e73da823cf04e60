"""Byte-level BPE, encoding and decoding, on numpy matrices.

Pretokens of about the same length are rows of a padded matrix of token ids. In each round every row merges its leftmost pair of
least rank: pairs are looked up in an open-addressing hash table, the rows close up by one place, and finished
rows leave the matrix. A pretoken that is a token itself needs no round; one of more than ``LONG`` bytes is merged
with a heap, as the rounds of a row grow with its length.

Nulls and defects: a null text is empty and has no ids; repeated rows get equal results; other columns pass by.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from .chunks import ChunkMemo
from .kernel import mix, pieces

NONE = np.int32(2**31 - 1)
LONG, CELLS = 1024, 2_000_000
_LOADED: dict[str, ByteBPE] = {}


class ByteBPE:
    """Ranks of a vocabulary file (base64 token and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._table(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(rank, np.int32))

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        size = 1 << max(4, int(len(keys) * 3).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32)
        slot, todo = mix(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], ranks[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge or a side is padding (-1)."""
        key = left.astype(np.uint64) << np.uint64(32) | (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = mix(key[todo]) & self.mask
        while len(todo):
            have = self.keys[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (have != np.uint64(2**64 - 1))
            todo, slot = todo[more], (slot[more] + np.uint64(1)) & self.mask
        return out

    def merge(self, rows: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of byte ids (padded with -1 at the end)."""
        out: list = [None] * len(rows)
        who, ids = np.arange(len(rows)), rows
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            if ids.shape[1] < 2:
                live = np.zeros(len(ids), bool)
            else:
                at = rank.argmin(1)
                best = rank[np.arange(len(ids)), at]
                live = best != NONE
            if not live.all():
                for w, row in zip(who[~live].tolist(), ids[~live], strict=True):
                    out[w] = row[row >= 0]
                who, ids = who[live], ids[live]
                if not len(ids):
                    return out
                rank, at, best = rank[live], at[live], best[live]
            every = np.arange(len(ids))
            ids[every, at] = best
            col = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            if ids.shape[1] < 2:
                continue
            col = np.arange(ids.shape[1] - 1)
            rank = np.take_along_axis(rank, col + (col >= at[:, None]), 1)
            before, behind = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            rank[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
            rank[behind, at[behind]] = self.rank(ids[behind, at[behind]], ids[behind, at[behind] + 1])

    def merge_long(self, text: bytes) -> np.ndarray:
        """The same ids for one long pretoken: a heap of pairs over a linked list."""
        ids = self.byte[np.frombuffer(text, np.uint8)].tolist()
        n = len(ids)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        find = lambda a, b: self.ranks.get(self.tokens[a] + self.tokens[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = behind[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = r, 1
            behind[i] = behind[j]
            if behind[j] < n:
                before[behind[j]] = i
                if (s := find(r, ids[behind[j]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[behind[j]]))
            if (h := before[i]) >= 0 and (s := find(ids[h], r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return np.array([x for x, g in zip(ids, gone, strict=True) if not g], np.int32)

    def encode_pretokens(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        for i, t in enumerate(texts):
            if (r := self.ranks.get(t)) is not None:
                out[i] = np.array([r], np.int32)
                size[i] = 0
            elif size[i] > LONG:
                out[i] = self.merge_long(t)
                size[i] = 0
        order = np.argsort(size, kind="stable")
        at = int(np.searchsorted(size[order], 1))
        while at < len(order):
            least = int(size[order[at]])
            width = least + max(1, least // 4)  # rows of a bucket are at most a quarter longer than its first
            to = min(int(np.searchsorted(size[order], width, "right")), at + max(1, CELLS // width))
            rows = order[at:to]
            width = int(size[rows[-1]])
            ids = np.full((len(rows), width), -1, np.int32)
            inside = np.arange(width) < size[rows][:, None]
            ids[inside] = self.byte[np.frombuffer(b"".join([texts[i] for i in rows.tolist()]), np.uint8)]
            for i, x in zip(rows.tolist(), self.merge(ids), strict=True):
                out[i] = x
            at = to
        return out

    def encoder(self, pattern: str) -> ChunkMemo:
        import regex

        split = regex.compile(pattern)

        def encode(chunks: list[str]) -> list[bytes]:
            cut = [[m.encode() for m in split.findall(c)] for c in chunks]
            new = list({m for c in cut for m in c})
            known = {m: x.tobytes() for m, x in zip(new, self.encode_pretokens(new), strict=True)}
            return [b"".join([known[m] for m in c]) for c in cut]

        return ChunkMemo(encode)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = load(path).encoder(pattern)
        for batch in pieces(batches, 1):
            ids = [np.frombuffer(x, np.int32) for x in memo.ids([t or "" for t in batch.column(1).to_pylist()])]
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=off[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(doc_id, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of the ids."""
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids, each text in one go; only digests leave the task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        memo, decimal = model.encoder(pattern), [str(i) for i in range(len(model.tokens))]
        for batch in pieces(batches, 1):
            count, own, back = [], [], []
            for packed in memo.ids([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(packed, np.int32).tolist()
                count.append(len(ids))
                own.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(own), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

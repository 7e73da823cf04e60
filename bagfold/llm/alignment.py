"""Alignment of two tokenisers' tokens over a corpus.

Both vocabularies' tokens are byte ranges of the same text. Overlapping ranges are the edges of a bipartite graph, whose connected components, found by
union-find, are the minimal groups of tokens that cover the same bytes. Within a component, an A and a B token that end at one place
are linked. No token of either kind runs over a space that follows a non-space, so texts are cut there and each
distinct chunk is encoded and aligned once a task. A document's links are written packed; id pairs are counted over the corpus (packed by bucket), and the counts
come back by a broadcast list of the most frequent pairs, and by a join for the others.

Nulls and defects: a null or empty text, and one whose pieces don't give its bytes back (one with U+2581), has no tokens. Texts are taken whole.
A null doc_id is passed on. Repeated rows are counted each. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .components import union_find
from .kernel import as_text, binary_array, blocks, per_doc, pieces, run_starts, trim
from .packing import encoder, vocabulary
from .tally import Tally, distinct, find, frequent, rest_sums, totals

ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
#: Characters of chunks that a task remembers before it starts afresh, and what one chunk counts besides.
MEMO_CHARS, CHUNK_CHARS = 32 << 20, 100
#: Pairs of the broadcast list (some 20 bytes each).
LISTED = 1 << 19
#: A pair is one number: the A id above so many bits of the B id.
B_BITS = 16


def piece_bytes(model) -> list[bytes]:
    """What each id of a sentencepiece model stands for."""
    return [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]


class Aligner:
    """Chunks of texts, each encoded by both vocabularies and aligned once. A chunk is known by what follows its leading space."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        import sentencepiece

        self.encode_a = encoder(path_a, pattern)
        tokens, added = vocabulary(path_a)
        self.a_size = 1 + max([*tokens.values(), *added.values()])
        self.a_bytes = np.zeros(self.a_size, np.int64)
        for t, i in tokens.items():
            self.a_bytes[i] = len(t)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_pieces = piece_bytes(self.model)
        self.b_bytes = np.array([len(x) for x in self.b_pieces])
        if max(len(self.b_pieces), self.a_size) > 1 << B_BITS:
            raise ValueError("vocabularies of over 65536 ids")
        names = [f"{i}" for i in range(max(self.a_size, len(self.b_pieces)))]
        self.names = [f"{x}{mark}" for mark in ",|;" for x in names]  # by mark, then id
        self.space = self.model.encode("x ")[1:]
        self.run = re.compile(r"(?:^|\s) ")
        self.cut = re.compile(r"(?<=\S) ")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.facts = np.zeros((5, 0), np.int64)  # good, n_a, n_b, n_groups, n_links
        self.links, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        if self.run.search(text) is None:
            return text.split(" ")
        out = self.cut.split(" " + text)
        out[0] = out[0][1:]
        return out

    def learn(self, new: list[str]) -> None:
        a = [self.encode_a(" " + x, disallowed_special=()) for x in new]
        b = [ids if x else self.space for x, ids in zip(new, self.model.encode(new, num_threads=1), strict=True)]
        piece = self.b_pieces
        good = np.array([b"".join([piece[i] for i in ids]) == b" " + x.encode() for x, ids in zip(new, b, strict=True)], bool)
        n_a = np.where(good, [len(x) for x in a], 0)
        n_b = np.where(good, [len(x) for x in b], 0)
        flat_a = np.concatenate([np.zeros(0, np.int64), *(x for x, ok in zip(a, good, strict=True) if ok)]).astype(np.int64)
        flat_b = np.array([i for x, ok in zip(b, good, strict=True) if ok for i in x], np.int64)
        chunk_a, chunk_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        end_a, end_b = np.cumsum(self.a_bytes[flat_a]), np.cumsum(self.b_bytes[flat_b])
        group_a, group_b, link_a, link_b = align(end_a, end_b)
        link = (flat_a[link_a] << B_BITS | flat_b[link_b]).astype(np.uint32)
        first = run_starts(group_a) if len(group_a) else np.zeros(0, bool)
        facts = np.stack([good, n_a, n_b, np.bincount(chunk_a[first], minlength=len(new)), np.bincount(chunk_a[link_a], minlength=len(new))]).astype(np.int64)
        # the text form: A ids, a bar, B ids, a semicolon, group by group
        wide = len(self.names) // 3
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)], np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
        code = np.concatenate([flat_a + wide * last_a, flat_b + 2 * wide * last_b])
        order = np.lexsort((np.repeat([0, 1], [len(flat_a), len(flat_b)]), np.concatenate([group_a, group_b])))
        names = [self.names[c] for c in code[order].tolist()]
        at = np.append(0, np.cumsum(n_a + n_b)).tolist()
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += ["".join(names[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        self.facts = np.concatenate([self.facts, facts], 1)
        self.links = np.concatenate([self.links, link])
        self.offsets = np.append(0, np.cumsum(self.facts[4]))
        self.chars += sum(map(len, new)) + CHUNK_CHARS * len(new)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text: n_a, n_b, n_groups, n_links and the digest of the groups; all links, and their bounds by text."""
        if self.chars > MEMO_CHARS:
            self.clear()
        parts = [self.chunks(t) if t else [] for t in texts]
        if new := list({x for p in parts for x in p} - self.place.keys()):
            self.learn(new)
        size = np.array([len(p) for p in parts], np.int64)
        idx = np.fromiter((self.place[x] for p in parts for x in p), np.int64, int(size.sum()))
        bounds = np.append(0, np.cumsum(size))
        whole = per_doc(self.facts[0][idx], bounds) == size
        idx, size = idx[np.repeat(whole, size)], np.where(whole, size, 0)
        bounds = np.append(0, np.cumsum(size))
        facts = np.stack([per_doc(row[idx], bounds) for row in self.facts[1:]])
        count = self.facts[4][idx]
        start = np.cumsum(count) - count
        links = self.links[np.repeat(self.offsets[idx] - start, count) + np.arange(int(count.sum()))]
        get, at = self.groups.__getitem__, idx.tolist()
        sha = [hashlib.sha256("".join(map(get, at[i:j]))[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return facts, sha, links, np.append(0, np.cumsum(facts[3]))


def align(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components (numbered in order) of two covers of the same bytes, given by their tokens' ends; and the linked tokens."""
    if not len(end_a):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # between two neighbouring ends of either kind lie one A and one B token: all overlaps, each once
    cuts = np.unique(np.concatenate([end_a, end_b]))
    over_a, over_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    _, root = union_find(over_a, len(end_a) + over_b)
    _, group = np.unique(root, return_inverse=True)
    ends = end_a[over_a] == end_b[over_b]
    return group[: len(end_a)], group[len(end_a) :], over_a[ends], over_b[ends]


def _aligned(path_a: str, pattern: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, pattern, path_b)
        for batch, _, _ in blocks(batches):
            facts, sha, links, bounds = aligner.documents(as_text(batch.column(2)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(f) for f in facts), pa.array(sha), binary_array(links.view(np.uint8), 4 * bounds)], names=[x.split()[0] for x in ALIGNED.split(", ")])
        aligner.clear()
        trim()

    return run


def aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ALIGNED, written: a row a document with its links packed as 32-bit numbers."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return materialize(rows.mapInArrow(_aligned(path_a, pattern, path_b), ALIGNED), "aligned")


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), np.uint32), (off - off[0]) // 4


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(buckets)
        for batch in pieces(batches, 0, 4 << 20):
            key, n = distinct(_links(batch.column(0))[0])
            yield from tally.add(key.astype(np.int64), n)
        yield from tally.close()

    return run


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n, best), written: how many links of ALIGNED rows hold an id pair, and 1 if no other pair of its B id has more."""
    width = shuffle_width(links.sparkSession)
    counts = links.select("links").mapInArrow(_counted(width), "bucket int, keys binary, counts binary")
    pairs = materialize(totals(counts, width), "pairs")
    piece = F.col("key").bitwiseAND((1 << B_BITS) - 1)
    most = pairs.groupBy(piece.alias("piece")).agg(F.max("n").alias("most"))  # one row an id of B, at most 2**B_BITS
    return materialize(pairs.withColumn("piece", piece).join(F.broadcast(most), "piece").select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")


def _scored(listed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = listed.value
        for batch in pieces(batches, 7, 4 << 20):
            links, bounds = _links(batch.column(7))
            key = links.astype(np.int64)
            at, there = find(keys, key)
            values = [per_doc(np.where(there, v[at], 0) if len(v) else np.zeros(len(key), np.int64), bounds) for v in (best, count)]
            rest = binary_array(np.ascontiguousarray(key[~there]).view(np.uint8), np.append(0, np.cumsum(~there))[bounds] * 8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *(pa.array(v) for v in values), rest], names=[*batch.schema.names[:7], "n_best", "count_sum", "rest"])

    return run


def with_counts(links: DataFrame, pairs: DataFrame, listed: int = LISTED) -> DataFrame:
    """ALIGNED rows with ``n_best`` and ``count_sum`` over their links."""
    spark = links.sparkSession
    few, every = frequent(pairs, listed)
    table = few.toArrow().sort_by("key")
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "n", "best")))
    out = links.mapInArrow(_scored(known), ALIGNED.replace("links binary", "n_best long, count_sum long, rest binary"))
    if every:
        return out.drop("rest")
    out = materialize(out, "scored-links")
    more = rest_sums(out, pairs.select("key", F.col("best").alias("more_best"), F.col("n").alias("more_sum")), "more_best", "more_sum")
    more = out.drop("rest").join(more, "rid", "left")
    return more.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("more_best", "more_sum")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    links = aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return with_counts(links, pair_counts(links)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""Word n-gram Jaccard join by grouped prefixes.

A document's set holds its distinct shingles (64-bit hashes). In one global order, rare shingles first, two sets that reach the
threshold share a shingle of their prefixes. Documents with the same prefix and size form a group, so that copies and
near copies enter the join once.

1. Order: the most frequent shingles (a list of fixed length, from counts over all documents) come last, by frequency;
   the others by hash. Any order gives the same links; a better one fewer candidates.
2. Groups: (shingle, size, group) for every shingle of a prefix, range-partitioned and sorted; neighbours in this order, and
   the members of a group with its first, are candidates. Verified ones make components.
3. What is left: wherever a shingle (or a group) joins several components, pairs across components whose sizes
   and parity sketches allow a link are verified as well. A sketch has a bit for the parity of the shingles hashed
   to it; as two sketches differ in no more bits than the sets differ in shingles, no link is lost. A few rounds try
   some partners of each document only, by hash, so that components which many links join have grown together before
   the last round tries every pair that is left.

So every link between different texts is found or lies within a component that others already hold together, and a
large group of near copies costs its size, not its square. Components come from ``components``.

Nulls and defects: texts that are null or have no words have the empty set and no links; shorter texts than a
shingle are one shingle of their own length. A null doc_id is never the smallest unless alone. Repeated rows
share a component. Very long texts are taken whole: a block of postings ends by its shingles as well as by its rows. Other columns pass by; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import drop_unread, materialize, shuffle_width, ship
from .components import components
from .kernel import LOWER, Words, blocks, complete_runs, mix, pieces, places, raw_windows, run_starts, signed
from .keys import few, small
from .lines import doc_key
from .substring import SQUEEZED, squeeze, text_rows, unsqueeze

#: Length of the list of frequent shingles, and of what one chunk of documents may name for it.
FREQUENT, FREQUENT_CHUNK, CHUNK_SHINGLES = 1 << 17, 1 << 14, 2_000_000
#: Rows of one block where many documents of different components share a shingle.
BLOCK_ROWS, BLOCK_SHINGLES = 2000, 1 << 25
#: Pairs that a task holds before it hands them on.
HELD_PAIRS = 20_000
#: Fixed value: how a Zstandard frame begins. No UTF-8 text does.
ZSTD_MAGIC = bytes([0x28, 0xB5, 0x2F, 0xFD])
#: Rounds with so many partners a document and shingle, before the one with all.
SPARSE_ROUNDS, SPARSE_PARTNERS = 3, 1


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block in document order, and bounds per document (repeats included)."""
    low = LOWER[buf]
    words = Words(low, off)
    h = words.hashes()
    at = places(words.bounds, k)
    full = raw_windows(h, k)[at]
    doc = words.doc[at] if len(at) else at
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):  # the whole sequence as one shingle
        acc = []
        for d in short:
            x = h[words.bounds[d] : words.bounds[d + 1]]
            acc.append(raw_windows(x, len(x))[0])
        full, doc = np.concatenate([full, np.array(acc, np.uint64)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        full, doc = full[order], doc[order]
    return full, np.searchsorted(doc, np.arange(len(off)))


def sets(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted set of each document of a block."""
    full, bounds = shingles(buf, off, k)
    for i in range(len(off) - 1):
        x = np.sort(full[bounds[i] : bounds[i + 1]])
        yield x[run_starts(x)] if len(x) else x


def prefix_size(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def _frequent(k: int):
    def top(parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(parts))
        run = np.flatnonzero(run_starts(h))
        size = np.diff(np.append(run, len(h)))
        take = np.flatnonzero(size >= 3)
        if len(take) > FREQUENT_CHUNK:
            take = take[np.argsort(-size[take], kind="stable")[:FREQUENT_CHUNK]]
        return pa.RecordBatch.from_arrays([pa.array(signed(h[run[take]])), pa.array(size[take])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for _, buf, off in blocks(batches):
            for x in sets(buf, off, k):
                parts.append(x)
                rows += len(x)
            if rows >= CHUNK_SHINGLES:
                yield top(parts)
                parts, rows = [], 0
        if parts:
            yield top(parts)

    return run


def frequent_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their ranks from 1; at most ``FREQUENT``."""
    top = rows.select("text").mapInArrow(_frequent(k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h = top.column(0).to_numpy().view(np.uint64)[::-1]
    order = np.argsort(h)
    return h[order], order + 1


def _profile(k: int, percent: int, frequent):
    """(did, th, doc_id, n, sid, gid, prefix, sketch) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, rank = frequent.value
        for batch, buf, off in blocks(batches):
            whole = list(sets(buf, off, k))
            flat = np.concatenate(whole) if whole else np.zeros(0, np.uint64)
            if len(common) and len(flat):
                i = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                late = np.where(common[i] == flat, rank[i], 0)
            else:
                late = np.zeros(len(flat), np.int64)
            at, n, sid, gid, prefix, marks = 0, [], [], [], [], []
            for x in whole:
                marks.append(sketch(x))
                r = late[at : at + len(x)]
                at += len(x)
                n.append(len(x))
                sid.append(xxhash.xxh3_64_intdigest(x.tobytes()))
                if not len(x):
                    gid.append(0)
                    prefix.append(b"")
                    continue
                p = prefix_size(len(x), percent)
                early = x[r == 0]
                if len(early) < p:
                    rest = x[r > 0]
                    early = np.concatenate([early, rest[np.argsort(r[r > 0], kind="stable")]])
                prefix.append(early[:p].tobytes())
                gid.append(xxhash.xxh3_64_intdigest(prefix[-1], len(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(np.array(gid, np.uint64).view(np.int64)), pa.array(prefix, pa.binary()), pa.array(marks, pa.binary())],
                names=["did", "th", "doc_id", "n", "sid", "gid", "prefix", "sketch"],
            )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n, gid), once for each group of a batch."""
    for batch in batches:
        n, gid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        _, keep = np.unique(gid, return_index=True)
        part = batch.column(2).take(pa.array(np.sort(keep)))
        keep = np.sort(keep)
        token = [np.frombuffer(x.as_buffer(), np.int64) for x in part]
        size = np.array([len(x) for x in token], np.int64)
        if size.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.repeat(n[keep], size)), pa.array(np.repeat(gid[keep], size))], names=["token", "n", "gid"])


PAIR, SHARED, EDGE = 0, 1, 2
LINKED = "kind byte, token long, n long, a long, b long, range int"


def _neighbours(percent: int):
    """Sorted postings: candidate pairs of neighbours, postings of shared tokens, first and last posting of the range."""

    def rows(kind: int, token, n, a, b, part: int) -> pa.RecordBatch:
        m = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(token), pa.array(n), pa.array(a), pa.array(b), pa.array(np.full(m, part, np.int32))], names=["kind", "token", "n", "a", "b", "range"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: set[tuple[int, int]] = set()
        last = None
        for table in complete_runs(batches):
            token, n, gid = (table.column(i).to_numpy() for i in range(3))
            new = run_starts(token, n, gid)
            token, n, gid = token[new], n[new], gid[new]
            run_at = np.flatnonzero(run_starts(token))
            size = np.repeat(np.diff(np.append(run_at, len(token))), np.diff(np.append(run_at, len(token))))
            opening = last is None
            if opening:
                yield rows(EDGE, token[:1], n[:1], gid[:1], np.zeros(1, np.int64), part)
            last = (token[-1:], n[-1:], gid[-1:])
            shared = size > 1
            shared |= token == token[-1]  # the last run of a range, and the first, may go on elsewhere
            if opening:
                shared |= token == token[0]
            yield rows(SHARED, token[shared], n[shared], gid[shared], np.zeros(int(shared.sum()), np.int64), part)
            i = np.flatnonzero(token[1:] == token[:-1])
            i = i[100 * n[i] >= percent * n[i + 1]]
            if len(i):
                pairs = np.unique(np.stack([np.minimum(gid[i], gid[i + 1]), np.maximum(gid[i], gid[i + 1])], 1), axis=0)
                if len(seen) < 200_000:
                    fresh = [p for p in map(tuple, pairs.tolist()) if p not in seen]
                    seen.update(fresh)
                    pairs = np.array(fresh, np.int64).reshape(-1, 2)
                yield rows(PAIR, np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], part)
        if last is not None:
            yield rows(EDGE, last[0], last[1], last[2], np.ones(1, np.int64), part)

    return run


def sketch(x: np.ndarray) -> bytes:
    """Parity sketch of a set: four to eight bits a shingle, 64 at least, a power of two."""
    bits = 64
    while bits < 4 * len(x):
        bits *= 2
    slot = (mix(x) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def coarse(marks: DataFrame) -> DataFrame:
    """``marks`` with ``coarse``: the sketch folded to a quarter, which is what the many rows of shared tokens carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = []
            for x in batch.column(4):
                mark = np.frombuffer(x.as_buffer(), np.uint8)[None]
                small.append(_fold(mark, max(8, mark.shape[1] // 4)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(small, pa.binary())], names=["sid", "did", "th", "n", "sketch", "coarse"])

    return marks.select("sid", "did", "th", "n", "sketch").mapInArrow(run, "sid long, did long, th long, n long, sketch binary, coarse binary")


def _fetch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):  # sid, body
            whole = []
            for body in batch.column(1):
                raw = body.as_py()
                buf = np.frombuffer(unsqueeze(body) if raw[:4] == ZSTD_MAGIC else raw, np.uint8)
                whole.append(next(sets(buf, np.array([0, len(buf)], np.int64), k)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in whole], pa.binary())], names=["sid", "items"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a, b, items of a, items of b
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _fetched(pairs: DataFrame, have: DataFrame | None, docs: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """(sid, items): whole sets of the documents in ``pairs``, made only where ``have`` lacks them; ``docs`` are ``text_rows``.

    Few wanted documents are picked where they are read; for many, both sides are shuffled, the texts compressed.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    if have is not None:
        wanted = wanted.join(have.select("sid"), "sid", "left_anti")
    wanted = materialize(marks.join(wanted, "sid", "left_semi").select("sid", "did", "th"), "wanted")
    if few(wanted):
        bodies = docs.join(F.broadcast(wanted), ["did", "th"]).select("sid", F.encode("text", "UTF-8").alias("body"))
    else:
        bodies = docs.mapInArrow(squeeze, SQUEEZED).join(wanted, ["did", "th"]).select("sid", F.col("blob").alias("body"))
    items = materialize(bodies.dropDuplicates(["sid"]).mapInArrow(_fetch(k), "sid long, items binary"), "sets")
    return items if have is None else have.unionByName(items)


def _links(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs of sets (a, b) that reach the threshold."""
    left, right = items.select(F.col("sid").alias("a"), F.col("items").alias("x")), items.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "links")


def _may_link(percent: int):
    """Pairs (a, b, n and sketch of both) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8)[None], np.frombuffer(y.as_buffer(), np.uint8)[None]
                size = min(x.shape[1], y.shape[1])
                ok[i] = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) * (100 + percent) <= (100 - percent) * int(na[i] + nb[i])
            ok &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def _sifted(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link."""
    of = lambda side: marks.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return both.mapInArrow(_may_link(percent), "a long, b long")


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _across(percent: int, partners: int | None, turn: int):
    """Rows (key, side pair, own side, n, sid, root, coarse sketch) sorted by key: pairs across components that may link, all or ``partners`` a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        alive: set[int] = set()
        for table in complete_runs(batches, 3):
            key = [table.column(i).to_numpy() for i in range(3)]
            own, n, sid, root = (table.column(i).to_numpy() for i in range(3, 7))
            raw = table.column(7)
            run_at = np.append(np.flatnonzero(run_starts(*key)), len(sid))
            for lo, hi in zip(run_at[:-1], run_at[1:], strict=True):
                if hi - lo < 2:
                    continue
                order = np.argsort(n[lo:hi], kind="stable") + lo
                widths = [len(raw[int(i)].as_buffer()) for i in order]
                marks = [np.frombuffer(raw[int(i)].as_buffer(), np.uint8)[None] for i in order]
                nn, ss, rr, oo = n[order], sid[order], root[order], own[order]
                apart = key[1][lo] != key[2][lo]
                for j in range(len(order)):
                    # partners are larger, up to the size that still allows a link
                    top = int(np.searchsorted(nn, nn[j] * 100 // percent, "right"))
                    cand = np.arange(j + 1, top)
                    cand = cand[(rr[cand] != rr[j]) & (ss[cand] != ss[j])]
                    if apart:
                        cand = cand[oo[cand] != oo[j]]
                    if not len(cand):
                        continue
                    for w in sorted({widths[c] for c in cand.tolist()}):
                        group = np.array([c for c in cand.tolist() if widths[c] == w])
                        size = min(w, widths[j])
                        diff = _fold(np.concatenate([marks[c] for c in group]), size) ^ _fold(marks[j], size)
                        apart_bits = np.bitwise_count(diff).sum(1, dtype=np.int64)
                        # |x ^ y| <= (100 - p) / (100 + p) * (|x| + |y|) for a link
                        good = group[apart_bits * (100 + percent) <= (100 - percent) * (nn[group] + nn[j])]
                        if len(good):
                            alive.add(int(key[0][lo]))
                        if partners is not None and len(good) > partners:
                            lot = mix(ss[good].view(np.uint64) ^ ss[j : j + 1].view(np.uint64) ^ np.uint64(turn))
                            good = good[np.argpartition(lot, partners)[:partners]]
                        for c in good.tolist():
                            p = (min(int(ss[j]), int(ss[c])), max(int(ss[j]), int(ss[c])))
                            seen.add(p)
                    if len(seen) > HELD_PAIRS:
                        yield _pair_batch(seen)
                        seen.clear()
        if seen:
            yield _pair_batch(seen)
        if alive:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(alive), pa.int64()), pa.nulls(len(alive), pa.int64())], names=["a", "b"])

    return run


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(sorted(pairs), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def linked_components(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, did, th, n_shingles, root: documents with equal root (a set's hash) are linked; null: no set."""
    spark = docs.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    rows = docs.select(*doc_key(doc_id, text), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, k))
    profile = materialize(rows.mapInArrow(_profile(k, percent, frequent), "did long, th long, doc_id long, n long, sid long, gid long, prefix binary, sketch binary"), "profiles")
    full = profile.filter("n > 0")
    # candidates among neighbours
    order = ["token", "n", "gid"]
    postings = full.select("n", "gid", "prefix").mapInArrow(_postings, "token long, n long, gid long")
    found = materialize(postings.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(percent), LINKED), "postings")
    edge = found.filter(F.col("kind") == EDGE).select("range", "b", "token", "n", "a")
    before = Window.orderBy("range", "b")  # two rows a range
    edge = edge.select("token", "n", "a", F.lag("token").over(before).alias("t2"), F.lag("n").over(before).alias("n2"), F.lag("a").over(before).alias("b"))
    edge = edge.filter((F.col("token") == F.col("t2")) & (F.col("a") != F.col("b")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent))
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").unionByName(edge.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    # members of the groups
    member = full.select("gid", "sid", "n").distinct()  # a group's sets have one size
    first = materialize(member.groupBy("gid").agg(F.min("sid").alias("head"), F.count("*").alias("size"), F.max("n").alias("n")), "group-heads")
    heads = first.select(F.col("gid").alias("a"), F.col("head").alias("x"))
    tails = first.select(F.col("gid").alias("b"), F.col("head").alias("y"))
    chain = pairs.join(heads, "a").join(tails, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = materialize(first.filter("size > 1"), "groups")
    within = member.select("gid", "sid").join(small(several.select("gid", "head")), "gid").filter("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    marks = full.groupBy("sid").agg(F.min_by(F.struct("did", "th", "n", "sketch"), F.struct("did", "th")).alias("d")).select("sid", "d.*")
    marks = materialize(coarse(marks), "sketches")
    candidates = chain.unionByName(within).filter("a <> b").distinct()
    candidates = materialize(_sifted(candidates, marks, percent), "candidates")
    texts = text_rows(docs, doc_id, text)
    items = _fetched(candidates, None, texts, marks, k)
    links = _links(candidates, items, percent)
    roots = materialize(components(links), "roots")
    shared = found.filter(F.col("kind") == SHARED).select("token", F.col("a").alias("gid"), "n").unionByName(several.select(F.col("gid").alias("token"), "gid", "n"))
    tested = candidates
    turn = 0
    while turn <= SPARSE_ROUNDS:
        partners = SPARSE_PARTNERS if turn < SPARSE_ROUNDS else None
        drop_unread(spark)
        across = materialize(_pairs_across(shared, member, roots, marks, percent, partners, turn), "across")
        # a token none of whose pairs may link needs no further look, for components only grow
        shared = materialize(shared.join(small(materialize(across.filter("b is null").select(F.col("a").alias("token")).distinct(), "open-tokens")), "token", "left_semi"), "shared")
        rest = across.filter("b is not null").distinct().join(tested, ["a", "b"], "left_anti")
        rest = materialize(_sifted(rest, marks, percent), "rest")
        tested = tested.unionByName(rest)
        more = None
        if not rest.isEmpty():
            items = _fetched(rest, items, texts, marks, k)
            more = _links(rest, items, percent)
        if more is None or more.isEmpty():
            turn = max(turn + 1, SPARSE_ROUNDS)  # on to the round with all partners, or out of it
            continue
        roots = materialize(components(roots.select("node", "root").unionByName(more.select(F.col("a").alias("node"), F.col("b").alias("root")))), "roots")
        turn += 1
    return profile.join(small(roots).select(F.col("node").alias("sid"), "root"), "sid", "left").select("doc_id", "did", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("root"))


def _pairs_across(shared: DataFrame, member: DataFrame, roots: DataFrame, marks: DataFrame, percent: int, partners: int | None, turn: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a token (or a group) and may link, and (token, null) where there are any."""
    named = materialize(member.join(small(roots).withColumnRenamed("node", "sid"), "sid", "left").select("gid", "sid", F.coalesce("root", "sid").alias("root")), "members")
    span = named.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = shared.join(span, "gid").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("token")
    mixed = materialize(mixed, "mixed-tokens")
    left = materialize(shared.join(small(mixed), "token").join(named, "gid").select("token", "n", "sid", "root").distinct(), "mixed")
    # only tokens of more than one block need be known by name
    size = left.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    size = size.select("token", F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")).filter("blocks > 1")
    left = left.join(small(materialize(size, "blocks")), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = left.withColumn("own", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.join(marks.select("sid", "coarse"), "sid")
    cells = left.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col("n").cast("int").alias("n"), "sid", "root", "coarse")
    cells = cells.repartition(shuffle_width(shared.sparkSession), "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return cells.mapInArrow(_across(percent, partners, turn), "a long, b long")


def with_component_id(linked: DataFrame) -> DataFrame:
    """doc_id, did, th, n_shingles, component_id (smallest doc_id of the component)."""
    least = linked.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    return linked.join(small(materialize(least, "least")), "root", "left").select("doc_id", "did", "th", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_component_id(linked_components(docs, 4, 85)).select("doc_id", "n_shingles", "component_id")


def op4_sql(k: int = 4, percent: int = 85) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + {k} - 1], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {k} + 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= {percent} * (x.n + y.n - inter)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.first AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS first FROM reach GROUP BY doc_id) m USING (doc_id)"""


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one of smallest doc_id (then text hash), all columns kept."""
    linked = linked_components(docs, k, percent, doc_id, text)
    named = materialize(linked.withColumn("group", F.coalesce("root", F.xxhash64("did", "th"))).select("group", "doc_id", "did", "th"), "groups")
    stay = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("did").alias("did"), F.col("th").alias("th"))).alias("s")).select("s.did", "s.th").distinct()
    keys = [F.col("did").alias("__did"), F.col("th").alias("__th")]
    gone = materialize(named.select("did", "th").distinct().join(stay, ["did", "th"], "left_anti").select(*keys), "gone")
    twice = materialize(named.groupBy("did", "th").count().filter("count > 1").join(stay, ["did", "th"], "left_semi").select(*keys), "twice")
    did, th = doc_key(doc_id, text)
    on = ["__did", "__th"]
    kept = docs.withColumns({"__did": did, "__th": th}).join(small(gone), on, "left_anti")
    if not twice.isEmpty():  # of repeated rows one stays
        kept = kept.join(small(twice), on, "left_anti").unionByName(kept.join(small(twice), on, "left_semi").dropDuplicates(on))
    return kept.select(*[f"`{n}`" for n in docs.columns])


def op4_brute(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """Reference by plain sets, for small fixtures: doc_id -> (n_shingles, component_id)."""
    import re

    own = {}
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        own[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in own}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(own)
    index: dict[tuple, list[int]] = {}
    for i in ids:
        near = {j for s in own[i] for j in index.get(s, ())}
        for j in near:
            inter = len(own[i] & own[j])
            if 100 * inter >= percent * (len(own[i]) + len(own[j]) - inter):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in own[i]:
            index.setdefault(s, []).append(i)
    return {i: (len(own[i]), find(i)) for i in ids}

"""Repeated word windows across a corpus, by level-wise doubling.

A window of ``n`` words (20) that occurs again must hold a repeated window of ``n/4`` words (5), and around
it a repeated one of ``n/2`` (10). At the two lower levels a window is represented by its minimiser, the
shorter window of least hash inside it, which equal windows share; so the search loses none.

Level n/4: every distinct text sends its minimisers; those that no other place shares die. Level n/2: texts with survivors extend
them to windows of n/2 words and send these with the hashes of the full windows over them. Level n: where the n/2 window is
repeated, full windows are compared and every occurrence but the earliest is removed. As equal full windows share their
n/2 minimiser, they meet in one task. Tasks settle what they can before each shuffle, so that a window found everywhere
costs a row a task and not a row a document. An n/2 window with over ``HOT_ROWS`` rows (many texts begin alike and go on
differently) is split by its full windows, whose first occurrences are aggregated before the shuffle.

Exact copies of a text are all removed but the first (given n words) and take no part in the search. Windows are told apart
by 64-bit hashes, together with the shorter window's hash by 128 bits.

Nulls and defects: null and empty texts have no words. A null doc_id sorts first. Rows that share
doc_id but not text count as further documents after it, by text hash; equal rows get equal results. Very long texts are taken whole, one at a time.
Other columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .kernel import Words, binary_array, blocks, complete_runs, pieces, places, raw_windows, run_starts, signed, slide_min
from .keys import small
from .lines import doc_key

WINDOW = 20
CHUNK_ROWS = 400_000
#: Rows of one n/2 window that may meet in a task.
HOT_ROWS = 50_000
_LOW = np.uint64((1 << 24) - 1)

ASK, ASK_REPEATED, SETTLED = 0, 1, 2
SQUEEZED = "did long, th long, th2 long, blob binary"


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """did, th, th2 (a second hash of the text) and text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(*doc_key(doc_id, text), F.xxhash64(F.lit("second"), whole).alias("th2"), whole.alias("text"))


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for part in pieces(batches, 3):
        blob = [packer.compress(t.as_buffer()) for t in part.column(3)]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blob, pa.binary())], names=["did", "th", "th2", "blob"])


def squeezed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts compressed before a shuffle (``blob``)."""
    return text_rows(docs, doc_id, text).mapInArrow(squeeze, SQUEEZED)


def unsqueeze(blob: pa.BinaryScalar) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob.as_buffer())


def _minimiser(h: np.ndarray, n: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``n`` words the place of its minimiser of ``part`` words; and all part hashes."""
    short = raw_windows(h, part)
    place = np.arange(len(short), dtype=np.uint64) & _LOW
    least = slide_min((short & ~_LOW) | place, n - part + 1)
    rel = ((least & _LOW) - (np.arange(len(least), dtype=np.uint64) & _LOW)) & _LOW
    return np.arange(len(least)) + rel.astype(np.int64), short


def _anchors(n: int):
    """(key, h, th, state): minimisers of n/4 words of each text, settled within the chunk where possible."""

    def close(parts: list) -> pa.RecordBatch:
        h, th, twice = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((th, h))
        h, th, twice = h[order], th[order], twice[order]
        new = run_starts(h, th)  # a text that is met twice in the chunk counts once
        h, th, twice = h[new], th[new], np.logical_or.reduceat(twice, np.flatnonzero(new))
        run = np.flatnonzero(run_starts(h))
        size = np.diff(np.append(run, len(h)))
        rep = np.logical_or.reduceat(twice, run) | (size > 1)
        settled = np.repeat(rep, size)
        ask_h, ask_th, state = h[run], th[run], np.where(rep, ASK_REPEATED, ASK)
        key = np.concatenate([ask_h.view(np.int64), th[settled]])
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.concatenate([ask_h, h[settled]]).view(np.int64)), pa.array(np.concatenate([ask_th, th[settled]])), pa.array(np.concatenate([state, np.full(int(settled.sum()), SETTLED)]).astype(np.int8))],
            names=["key", "h", "th", "state"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch, buf, off in blocks(batches):
            words = Words(buf, off)
            at = places(words.bounds, n)
            if not len(at):
                continue
            place, short = _minimiser(words.hashes(), n, max(1, n // 4))
            place = place[at]
            place = place[run_starts(place)]  # least places rise with the window
            doc, h = words.doc[place], short[place]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.flatnonzero(run_starts(doc, h))
            th = batch.column(1).to_numpy()[doc[first]]
            parts.append((h[first], th, np.diff(np.append(first, len(h))) > 1))
            rows += len(first)
            if rows >= CHUNK_ROWS:
                yield close(parts)
                parts, rows = [], 0
        if parts:
            yield close(parts)

    return run


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (h): settled rows, and asking rows whose hash another text or place shares."""
    for table in complete_runs(batches):
        h, th, state = (table.column(i).to_numpy() for i in range(3))
        run = np.flatnonzero(run_starts(h))
        size = np.diff(np.append(run, len(h)))
        asks = state != SETTLED
        low = np.minimum.reduceat(np.where(asks, th, np.iinfo(np.int64).max), run)
        high = np.maximum.reduceat(np.where(asks, th, np.iinfo(np.int64).min), run)
        rep = np.logical_or.reduceat(state == ASK_REPEATED, run) | (low < high)
        out = (state == SETTLED) | ((state == ASK) & np.repeat(rep, size))
        yield pa.RecordBatch.from_arrays([pa.array(th[out]), pa.array(h[out])], names=["th", "h"])


def _extend(n: int):
    """Texts with surviving minimisers: runs of full windows by their n/2 minimiser, or removed at once.

    Rows: key, h (of the n/2 window), did, tie, at (first window), full (hashes), count (windows removed, else 0).
    """

    def close(parts: list) -> pa.RecordBatch | None:
        did, tie, at, half, full = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((at, tie, did, half, full))
        same = run_starts(full[order], half[order])
        lead = order[np.flatnonzero(same)][np.cumsum(same) - 1]  # the chunk's earliest occurrence
        lost = np.empty(len(order), bool)
        lost[order] = (did[order] != did[lead]) | (tie[order] != tie[lead]) | (at[order] != at[lead])
        new = run_starts(did, tie, half, lost) | (np.diff(at, prepend=at[:1] - 2) != 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        gone = lost[first]
        keep = ~np.repeat(gone, size)
        off = np.zeros(len(first) + 1, np.int64)
        np.cumsum(np.where(gone, 0, size) * 8, out=off[1:])
        raw = np.ascontiguousarray(full[keep]).view(np.uint8)
        key = np.where(gone, did[first] ^ at[first], signed(half)[first])
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.where(gone, 0, signed(half)[first])), pa.array(did[first]), pa.array(tie[first]), pa.array(at[first]), binary_array(raw, off), pa.array(np.where(gone, size, 0).astype(np.int32))],
            names=["key", "h", "did", "tie", "at", "full", "count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:  # did, tie, blob, alive
            for did, tie, blob, alive in zip(*(batch.column(i) for i in range(4)), strict=True):
                buf = np.frombuffer(unsqueeze(blob), np.uint8)
                words = Words(buf, np.array([0, len(buf)], np.int64))
                if len(words) < n:
                    continue
                h = words.hashes()
                place, short = _minimiser(h, n, max(1, n // 4))
                live = np.sort(alive.values.to_numpy().view(np.uint64))
                value = short[place]
                i = np.minimum(np.searchsorted(live, value), len(live) - 1)
                at = np.flatnonzero(live[i] == value)
                if not len(at):
                    continue
                mid, wide = _minimiser(h, n, max(1, n // 2))
                full = raw_windows(h, n)[at]
                parts.append((np.full(len(at), did.as_py()), np.full(len(at), tie.as_py()), at, wide[mid[at]], full))
                rows += len(at)
                if rows >= CHUNK_ROWS:
                    yield close(parts)
                    parts, rows = [], 0
        if parts:
            yield close(parts)

    return run


REMOVED = "did long, tie long, runs binary"


def _removed(did: np.ndarray, tie: np.ndarray, at: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """REMOVED: first words of removed windows as runs (start, count) of 64-bit numbers."""
    order = np.lexsort((at, tie, did))
    did, tie, at, count = did[order], tie[order], at[order], count[order]
    first = np.flatnonzero(run_starts(did, tie))
    off = np.append(first, len(did)) * 16
    raw = np.ascontiguousarray(np.stack([at, count], 1).astype(np.int64)).reshape(-1).view(np.uint8)
    return pa.RecordBatch.from_arrays([pa.array(did[first]), pa.array(tie[first]), binary_array(raw, off.astype(np.int64))], names=["did", "tie", "runs"])


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of full windows (h, did, tie, at, full) taken apart: h, full, did, tie, at of each."""
    for batch in batches:
        full = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(4)]
        size = np.array([len(x) for x in full], np.int64)
        row = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        h, did, tie, at = (batch.column(i).to_numpy()[row] for i in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.concatenate(full)), pa.array(did), pa.array(tie), pa.array(at + step)], names=["h", "full", "did", "tie", "at"])


def _lost_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _removed(*(batch.column(i).to_numpy() for i in range(3)), np.ones(batch.num_rows, np.int64))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by h: REMOVED."""
    for table in complete_runs(batches):
        h, did, tie, at = (table.column(i).to_numpy() for i in range(4))
        count = table.column(5).to_numpy().astype(np.int64)
        column = table.column(4).combine_chunks() if isinstance(table.column(4), pa.ChunkedArray) else table.column(4)
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        done = count > 0
        if done.any():
            yield _removed(did[done], tie[done], at[done], count[done])
        run = np.flatnonzero(run_starts(h))
        lone = np.repeat(np.diff(np.append(run, len(h))) == 1, np.diff(np.append(run, len(h))))
        live = np.flatnonzero(~done & ~lone)  # a half window met once ends here
        if not len(live):
            continue
        size = (off[live + 1] - off[live]) // 8
        data = np.frombuffer(column.buffers()[2], np.uint8)
        row = np.repeat(live, size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        full = data[off[0] : off[-1]].view(np.uint64)[(off[row] - off[0]) // 8 + step]
        d, t, a, hh = did[row], tie[row], at[row] + step, h[row]
        order = np.lexsort((a, t, d, hh, full))
        same = run_starts(full[order], hh[order])
        lead = order[np.flatnonzero(same)][np.cumsum(same) - 1]
        lost = order[(d[order] != d[lead]) | (t[order] != t[lead]) | (a[order] != a[lead])]
        if len(lost):
            yield _removed(d[lost], t[lost], a[lost], np.ones(len(lost), np.int64))


def repeated_windows(docs: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """did, th, th2, copy (of an earlier equal text), runs: (start, count) of windows that occur earlier.

    Only documents with something to remove have a row.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = text_rows(docs, doc_id, text)
    names = rows.select("did", "th", "th2").distinct()
    firsts = rows.groupBy("th", "th2").agg(F.min("did").alias("first"))
    shared = names.groupBy("did").agg((F.count("*") > 1).alias("shared"))
    info = names.join(firsts, ["th", "th2"]).join(shared, "did")
    info = materialize(info.select("did", "th", "th2", (F.col("did") > F.col("first")).alias("copy"), F.when(F.col("shared"), F.col("th")).otherwise(F.lit(0)).alias("tie")), "texts")

    width = shuffle_width(spark)
    anchors = rows.select("did", "th", "text").mapInArrow(_anchors(n), "key long, h long, th long, state byte")
    anchors = anchors.repartition(width, "key").select("h", "th", "state").sortWithinPartitions("h")
    alive = anchors.mapInArrow(_survivors, "th long, h long").groupBy("th").agg(F.collect_list("h").alias("alive"))
    live = info.filter("not copy").join(alive, "th").select("did", "th", "th2", "tie", "alive")
    texts = squeezed(docs, doc_id, text).join(live, ["did", "th", "th2"]).select("did", "tie", "blob", "alive")
    wide = texts.mapInArrow(_extend(n), "key long, h long, did long, tie long, at long, full binary, count int")
    wide = materialize(wide, "windows")
    hot = wide.filter("count = 0").groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOT_ROWS).select("h")
    hot = materialize(hot, "hot-windows")
    some = not hot.isEmpty()
    cold = wide.join(small(hot), "h", "left_anti") if some else wide
    cold = cold.repartition(width, "key").select("h", "did", "tie", "at", "full", "count").sortWithinPartitions("h")
    runs = cold.mapInArrow(_decide, REMOVED)
    if some:
        each = wide.filter("count = 0").join(small(hot), "h", "left_semi").select("h", "did", "tie", "at", "full").mapInArrow(_each_window, "h long, full long, did long, tie long, at long")
        place = F.struct("did", "tie", "at")
        lead = each.groupBy("h", "full").agg(F.min(place).alias("lead"), F.max(place).alias("last")).filter("lead <> last").select("h", "full", "lead")
        lost = each.join(lead, ["h", "full"]).filter(place > F.col("lead")).select("did", "tie", "at")
        # settled runs of hot windows are in the cold half, under a hash of their own
        runs = runs.unionByName(lost.mapInArrow(_lost_windows, REMOVED))
    runs = runs.groupBy("did", "tie").agg(F.collect_list("runs").alias("runs"))
    out = info.join(runs, ["did", "tie"], "left").filter("copy or runs is not null")
    return out.select("did", "th", "th2", "copy", "runs")


def kept_mask(n_words: int, copy: bool, runs: list[bytes] | None, n: int = WINDOW) -> np.ndarray:
    """Which words stay."""
    if copy and n_words >= n:
        return np.zeros(n_words, bool)
    change = np.zeros(n_words + 1, np.int64)
    for blob in runs or []:
        at, count = np.frombuffer(blob, np.int64).reshape(-1, 2).T
        np.add.at(change, at, 1)
        np.add.at(change, np.minimum(at + count + n - 1, n_words), -1)
    return np.cumsum(change[:-1]) == 0


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):  # did, blob, copy, runs
        n_words, n_removed, sha = [], [], []
        for blob, copy, runs in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = unsqueeze(blob).split()
            keep = kept_mask(len(words), bool(copy), runs)
            kept = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)], names=["did", "n_words", "n_removed", "kept_sha256"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = squeezed(docs).join(repeated_windows(docs), ["did", "th", "th2"], "left").select("did", "blob", "copy", "runs")
    out = texts.mapInArrow(_result, "did long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("did") != -(1 << 63), F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_sql() -> str:
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW} + 2)) AS i, words FROM w WHERE len(words) >= {WINDOW}),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW} - 1], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
k AS (SELECT x.doc_id, x.j, x.word, c.j IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""

"""Line dedup over a corpus: every common line stays in the first document that holds it.

Line hashes are range-partitioned and sorted by hash, document and position; each range is streamed
once and yields the lines whose document isn't the first of their hash. The first run and the last
run of a range may go on in a neighbouring range, so their rows that look first there are settled
in a small second step. Decisions come back as compressed keep bitmaps, one for each document that loses lines.

Nulls and defects: null and empty texts are one empty line. A null doc_id sorts before all others and counts as
one document, as do rows that share a doc_id. Repeated rows get equal results. Very long texts are split whole, one line list at a time. Other columns pass by;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .kernel import as_text, pieces

BLANK = b" \t\n\v\f\r"
NULL_ID = -(1 << 63)

HIT_SCHEMA = "h1 long, h2 long, did long, th long, pos int, n_lines int, open boolean"
BITMAP_SCHEMA = "did long, th long, n_lines int, keep binary"


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``did`` (null: smallest) and ``th``, a hash of the text, name a row; equal rows share them."""
    return [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th")]


def line_key(line: bytes, least: int) -> bytes | None:
    """The line's key, or None if it is shorter than ``least`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def _hashes(least: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 2):
            texts = as_text(batch.column(2)).cast(pa.binary())
            digests, pos, owner, size = [], [], [], []
            for i, text in enumerate(texts):
                parts = text.as_py().split(b"\n")
                for p, line in enumerate(parts):
                    if (key := line_key(line, least)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        pos.append(p)
                        owner.append(i)
                        size.append(len(parts))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(size, pa.int32())], names=["h1", "h2", "did", "th", "pos", "n_lines"]
            )

    return lines


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, did, pos): those that are not of their run's first document, and,
    ``open``, the rows of the first document of the range's first and last run."""
    held, first_run, last = None, True, None  # held: rows of the current run's first document
    names = ["h1", "h2", "did", "th", "pos", "n_lines"]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, did = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        joined = last is not None and (h1[0], h2[0]) == last[:2]
        if joined:
            new[0] = False
        starts = np.flatnonzero(new)
        first = np.empty(len(h1), np.int64)
        lead = starts[0] if len(starts) else len(h1)
        first[:lead] = last[2] if joined else 0
        first[lead:] = np.repeat(did[starts], np.diff(np.append(starts, len(h1))))
        table = pa.Table.from_batches([batch]).select(names)
        lost = did != first
        out = [table.filter(pa.array(lost)).append_column("open", pa.array(np.zeros(int(lost.sum()), bool)))]
        if not first_run and len(starts):
            held = None  # a run that began and ended within the range is settled
        if len(starts) and held is not None:
            # the run may end within this batch
            run = pa.concat_tables([held, table.slice(0, int(lead)).filter(pa.array(~lost[:lead]))])
            out.append(run.append_column("open", pa.array(np.ones(len(run), bool))))
            held, first_run = None, False
        if len(starts) and first_run and lead == 0 and len(starts) > 1:
            run = table.slice(0, int(starts[1])).filter(pa.array(~lost[: starts[1]]))
            out.append(run.append_column("open", pa.array(np.ones(len(run), bool))))
            first_run = False
        at = int(starts[-1]) if len(starts) else 0
        tail = table.slice(at).filter(pa.array(~lost[at:]))
        held = tail if held is None else pa.concat_tables([held, tail])
        last = (h1[-1], h2[-1], first[-1])
        for t in out:
            yield from t.combine_chunks().to_batches()
    if held is not None:
        yield from held.append_column("open", pa.array(np.ones(len(held), bool))).combine_chunks().to_batches()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, drop in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            bits = np.ones(n, bool)
            bits[np.asarray(drop.as_py(), np.int64)] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keep, pa.binary())], names=["did", "th", "n_lines", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep bitmaps of the documents that lose lines (``did``, ``th``: see doc_key)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*doc_key(doc_id, text), F.col(f"`{text}`").alias("text"))
    hits = materialize(rows.mapInArrow(_hashes(least), "h1 long, h2 long, did long, th long, pos int, n_lines int"), "line-hashes")
    order = ["h1", "h2", "did", "pos", "th"]
    ranged = hits.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    found = materialize(ranged.mapInArrow(_stream, HIT_SCHEMA), "line-hits")
    edge = found.filter("open")
    heads = edge.groupBy("h1", "h2").agg(F.min("did").alias("first"))
    late = edge.join(heads, ["h1", "h2"]).filter("did > first")
    drops = found.filter("not open").select("did", "th", "n_lines", "pos").unionByName(late.select("did", "th", "n_lines", "pos"))
    lists = drops.groupBy("did", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drop"))
    return lists.select("did", "th", "n_lines", "drop").mapInArrow(_bitmaps, BITMAP_SCHEMA)


def kept_text(text: str, keep: bytes | None) -> tuple[int, int, str]:
    """Lines, lines dropped, and the text of the others."""
    lines = text.split("\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    kept = [line for line, k in zip(lines, bits.tolist(), strict=True) if k]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` beside their keep bitmap (null where all lines stay), all columns kept under ``doc``."""
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *doc_key(doc_id, text))
    return left.join(bitmaps.select("did", "th", "keep"), ["did", "th"], "left").select("doc", "keep")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        out = [kept_text(t or "", k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = with_bitmaps(docs, keep_bitmaps(docs)).select("doc.doc_id", "doc.text", "keep")
    return rows.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def line_dedup(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lost lines cut from ``text``, other columns unchanged; a document that lost lines and has only blanks left goes."""
    schema, at = docs.schema, docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            keep = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if k is None else kept_text(t or "", k)[2] for t, k in zip(batch.column(at).to_pylist(), keep, strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            left = pa.array([k is None or bool(t.strip(BLANK.decode())) for t, k in zip(texts, keep, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(left)

    rows = with_bitmaps(docs, keep_bitmaps(docs, least, doc_id, text), doc_id, text).select("doc.*", F.col("keep").alias("__keep"))
    return rows.mapInArrow(cut, schema)


def op9_sql() -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{lower}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, f.first IS NULL OR f.first = k.doc_id AS keep FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

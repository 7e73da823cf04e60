"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress independently. A bundle's last but one part is a skippable frame with its index (for each record
its identifier, frame, offset and length within the plain frame), the last a skippable frame with the seek table (compressed and plain size
of each frame). So a bundle describes itself: a record is found by the index entry and read by decompressing its own frame only.
Equal payloads are stored once: the record with the smallest identifier is the ``response``, others are ``revisit`` records that name it.

Bundles are one file each, written by Spark's own text writer (a bundle is a row whose line end is the last byte of the bundle), so they are files in
any store that Spark can write, appear with the job's commit, and attempts that are lost leave none. They are read by Spark's binary file reader.
Only identifiers and hashes of payloads are shuffled, unless so many payloads repeat that their list can't be broadcast; then
the rows meet it by identifier and hash.

Nulls and defects: a null payload is empty, a null url an empty target. A null identifier never is the
smallest (unless all are null, then each is a response); rows that repeat the smallest identifier
are each a response. Payloads of any size fit: a frame takes one record at least. Other columns
do not matter; an empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import delete_at_end, materialize, scratch_path, ship
from . import keys

# Fixed values of the seekable Zstandard format (skippable frames, the last with a seek table).
INDEX_MAGIC, SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20

INDEX_SCHEMA = "record_id string, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long"

#: (record identifier, frame, offset in the plain frame, length)
Entry = tuple[str, int, int, int]


def seal(frames: list[tuple[bytes, int]], entries: list[Entry]) -> bytes:
    """A bundle of compressed frames (with their plain sizes), its index and its footer."""
    import zstandard

    listed = zstandard.ZstdCompressor(level=3).compress("\n".join(f"{k} {o} {n} {r}" for r, k, o, n in entries).encode())
    index = struct.pack("<II", INDEX_MAGIC, len(listed)) + listed
    table = b"".join(struct.pack("<II", len(f), n) for f, n in [*frames, (index, 0)])
    footer = struct.pack("<IBI", len(frames) + 1, 0, SEEKABLE_MAGIC)
    return b"".join(f for f, _ in frames) + index + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer


def seek_table(bundle: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame; plain size 0: the index."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    body = bundle[-9 - count * width : -9]
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", body, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def entries(bundle: bytes | memoryview) -> list[Entry]:
    """The bundle's index; no record is decompressed."""
    import zstandard

    at, packed, _ = seek_table(bundle)[-1]
    magic, size = struct.unpack("<II", bundle[at : at + 8])
    if magic != INDEX_MAGIC or size + 8 != packed:
        raise ValueError("no index before the seek table")
    listed = zstandard.ZstdDecompressor().decompress(bytes(bundle[at + 8 : at + packed])).decode()
    cut = (x.split(" ", 3) for x in listed.split("\n") if x)
    return [(r, int(k), int(o), int(n)) for k, o, n, r in cut]


def unframe(bundle: bytes | memoryview, frame: int) -> bytes:
    import zstandard

    at, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bytes(bundle[at : at + packed]), max_output_size=plain)


def fetch(bundle: bytes | memoryview, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; only its own frame is decompressed."""
    return parse(unframe(bundle, frame), offset)[:2]


def record(identifier: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(identifier)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    stop = plain.index(b"\r\n\r\n", at)
    lines = plain[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    return head, plain[stop + 4 : end], end + 4


def _identifier(text: str) -> int | None:
    value = text[len("<urn:x-page:") : -1]
    return None if value == "null" else int(value)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles without their last byte, which the writer puts at the end of each."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    frames: list[tuple[bytes, int]] = []
    index: list[Entry] = []
    buffer: list[bytes] = []
    plain = packed = 0

    def close_frame() -> None:
        nonlocal plain, packed
        if buffer:
            frames.append((packer.compress(b"".join(buffer)), plain))
            packed += len(frames[-1][0])
            buffer.clear()
            plain = 0

    def close_bundle() -> pa.RecordBatch:
        nonlocal packed
        content = seal(frames, index)
        frames.clear()
        index.clear()
        packed = 0
        return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], names=["content"])

    for batch in batches:
        for page, url, html, sha, first in zip(*(batch.column(i) for i in range(5)), strict=True):
            page, first = page.as_py(), first.as_py()
            raw = record(page, url.as_py(), (html.as_py() or "").encode(), base64.b32encode(bytes.fromhex(sha.as_py())).decode(), None if first is None or first == page else first)
            index.append((f"<urn:x-page:{'null' if page is None else page}>", len(frames), plain, len(raw)))
            buffer.append(raw)
            plain += len(raw)
            if plain >= FRAME_BYTES:
                close_frame()
            if packed >= BUNDLE_BYTES:
                yield close_bundle()
    close_frame()
    if frames:
        yield close_bundle()


def _with_first(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``first``: the smallest identifier with the same payload, null where no other row has it."""
    copies = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 and first is not null")
    copies = materialize(copies.select("sha", "first"), "payload-copies")
    if keys.few(copies):
        return rows.join(F.broadcast(copies), "sha", "left")
    # identifiers meet the copies by hash, where a hot hash is a few numbers a row; the payloads meet the result by identifier
    again = rows.select("page_id", "sha").join(copies, "sha").filter("page_id is null or page_id <> first").distinct()
    again = again.select(F.coalesce("page_id", F.lit(0)).alias("__id"), F.col("page_id").isNull().alias("__none"), "sha", "first")
    keyed = rows.withColumns({"__id": F.coalesce("page_id", F.lit(0)), "__none": F.col("page_id").isNull()})
    return keyed.join(again, ["__id", "__none", "sha"], "left")


def write_archive(pages: DataFrame, directory: str, identifier: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Write ``pages`` as bundles, one file each, under ``directory`` (which must not exist); payloads smaller than ``least`` bytes are not deduplicated."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(f"`{identifier}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    made = _with_first(rows, least).select("page_id", "url", "html", "sha", "first").mapInArrow(_bundles, "content binary")
    end = struct.pack("<I", SEEKABLE_MAGIC)[-1:].decode("latin-1")
    made.select(F.col("content").cast("string").alias("value")).write.options(encoding="ISO-8859-1", lineSep=end, maxRecordsPerFile=1).text(directory)


def _files(spark: SparkSession, directory: str) -> DataFrame:
    """bundle (file name) and content."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(directory).filter("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = entries(memoryview(content.as_buffer()))
            cols = [[e[i] for e in own] for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array([bundle] * len(own)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["record_id", "bundle", "frame", "offset", "length"])


def read_index(spark: SparkSession, directory: str) -> DataFrame:
    """INDEX_SCHEMA: where each record of the archive lies."""
    return _files(spark, directory).mapInArrow(_list, INDEX_SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bundle, content and (or all) ``wanted`` entries (frame, offset, record_id): the records, each by its index entry, their payloads held against their digests."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
    for batch in batches:
        wanted = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for bundle, content, some in zip(batch.column(0).to_pylist(), batch.column(1), wanted, strict=True):
            data, out, frame, plain = memoryview(content.as_buffer()), [], None, b""
            places = sorted((x["frame"], x["offset"], x["record_id"]) for x in some) if some is not None else sorted((k, o, r) for r, k, o, _ in entries(data))
            for k, offset, name in places:
                if k != frame:
                    frame, plain = k, unframe(data, k)
                head, block, _ = parse(plain, offset)
                cut = block.index(b"\r\n\r\n") + 4
                size = int(next(x for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Record-ID"] != name or head["WARC-Type"] == "response" and (len(block) - cut != size or base64.b32encode(hashlib.sha1(block[cut:]).digest()).decode() != digest):
                    raise ValueError(f"damaged record {name}")
                out.append((_identifier(name), size, digest, head["WARC-Type"], _identifier(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, bundle, k, offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_archive(spark: SparkSession, directory: str, wanted: DataFrame | None = None) -> DataFrame:
    """RECORD_SCHEMA: every record of the archive, or those of ``wanted`` (entries of its index), of which only the frames are decompressed."""
    files = _files(spark, directory)
    if wanted is not None:
        listed = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "record_id")).alias("wanted"))  # a bundle's own records at most
        files = files.join(listed, "bundle")
    return files.mapInArrow(_read, RECORD_SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    directory = scratch_path(spark, "warc")
    write_archive(pages, directory)
    delete_at_end(spark, directory)
    return read_archive(spark, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sql() -> str:
    five = "('0x' || substr(hex, 1 + 10 * g, 10))::BIGINT"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({five} >> (35 - 5 * j)) & 31)::INT, 1)"
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes,
       array_to_string(flatten(list_transform(range(0, 4), lambda g: list_transform(range(0, 8), lambda j: {letter}))), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)"""

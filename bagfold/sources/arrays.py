"""Bags and vectors stored as NumPy files.

Packed bags are a matrix of all points and the offsets of the bags in it; single vectors are one matrix. Files are mapped, not read whole: each task
takes a range of rows. The path must be one that Python opens on the driver and the executors (a shared mount).

``save_packed`` writes such files from all tasks at once. Bags are sorted into ranges by id; counts by range, added up, tell where a range's rows and offsets begin;
each task writes its bytes at their place in a new file, and when all are there both files are renamed. A task that fails or runs twice writes the same bytes in the
same place; a job that fails leaves nothing, and what was there before stays.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, ship, shuffle_width

#: Numbers (about) that one task takes at a time.
STEP_NUMBERS = 1 << 22


def _ranges(spark: SparkSession, rows: int, step: int) -> DataFrame:
    starts = spark.range(0, rows, step)
    return starts.select(F.col("id").alias("start"), F.least(F.col("id") + step, F.lit(rows)).alias("stop"))


def _nested(x: np.ndarray, off: np.ndarray) -> pa.Array:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, np.float32).reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), flat)


def load_packed(spark: SparkSession, points: str, offsets: str, dimension: int | None = None) -> DataFrame:
    """(id, vecs) of packed bags; ids are the bags' places from 0."""
    ship(spark)
    x, off = np.load(points, mmap_mode="r"), np.load(offsets, mmap_mode="r")
    if x.ndim != 2 or off.ndim != 1 or (len(off) and (off[0] != 0 or off[-1] != len(x))) or dimension not in (None, x.shape[1]):
        raise ValueError(f"{points} and {offsets} are not packed bags" + (f" of {dimension} dimensions" if dimension else ""))
    bags = max(0, len(off) - 1)
    step = max(1, STEP_NUMBERS * bags // max(1, x.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, at = np.load(points, mmap_mode="r"), np.load(offsets, mmap_mode="r")
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.asarray(at[a : b + 1], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), _nested(np.asarray(data[own[0] : own[-1]]), own - own[0])], names=["id", "vecs"])

    return _ranges(spark, bags, step).mapInArrow(run, "id long, vecs array<array<float>>")


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, sv) of a matrix of single vectors; ids are the rows' places from 0."""
    ship(spark)
    x = np.load(path, mmap_mode="r")
    if x.ndim != 2:
        raise ValueError(f"{path} is not a matrix")
    step = max(1, STEP_NUMBERS // max(1, x.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(path, mmap_mode="r")
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.asarray(data[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), _nested(part, np.array([0, len(part)])).flatten()], names=["id", "sv"])

    return _ranges(spark, len(x), step).mapInArrow(run, "id long, sv array<float>")


def _header(shape: tuple[int, ...], kind: np.dtype) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
    return out.getvalue()


def offsets_type(points: int) -> np.dtype:
    """32 bits where they are enough."""
    return np.dtype("<i4") if points <= np.iinfo(np.int32).max else np.dtype("<i8")


def save_packed(bags: DataFrame, points: str, offsets: str, dimension: int) -> DataFrame:
    """Write bags (id, vecs) as a matrix of all points and the offsets of the bags in it, in order of the ids; returns (id, place).

    A null bag is an empty one. Vectors of another width than ``dimension`` are an error.
    """
    spark = bags.sparkSession
    ship(spark)
    rows = bags.select("id", F.coalesce(F.col("vecs").cast("array<array<float>>"), F.expr("cast(array() as array<array<float>>)")).alias("vecs"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange(shuffle_width(spark), "id", "tie").sortWithinPartitions("id", "tie")
    rows = materialize(rows.select("id", "vecs", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("nth")), "packed")
    sizes = sorted((r.range, r.bags, r.points, r.least) for r in rows.groupBy("range").agg(F.count("*").alias("bags"), F.sum(F.size("vecs")).alias("points"), F.min("nth").alias("least")).collect())  # one row a range
    first, bag, point = {}, 0, 0
    for r, n, m, least in sizes:
        first[r] = (bag, point, least)
        bag, point = bag + n, point + m
    kind = offsets_type(point)
    heads = [_header((point, dimension), np.dtype("<f4")), _header((bag + 1,), kind)]
    targets = [os.path.abspath(points), os.path.abspath(offsets)]
    made = [f"{t}.{uuid.uuid4().hex}" for t in targets]
    for path, head, size in zip(made, heads, (4 * point * dimension, kind.itemsize * (bag + 1)), strict=True):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(head)
            f.truncate(len(head) + size)  # the first offset is the zero that stands there

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(made[0], "r+b") as p, open(made[1], "r+b") as o:
            now, at = None, 0
            for batch in batches:
                lane, nth = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                size = np.diff(np.asarray(batch.column(0).offsets))
                flat = batch.column(0).flatten()
                if (np.diff(np.asarray(flat.offsets)) != dimension).any():
                    raise ValueError(f"vectors must have {dimension} numbers")
                numbers = flat.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                begin = np.append(0, np.cumsum(size))
                for r in np.unique(lane).tolist():
                    own = np.flatnonzero(lane == r)
                    bag, point, least = first[r]
                    if now != r:
                        now, at = r, point
                    if int(nth[own[0]]) != least + seen.get(r, 0):
                        raise ValueError("rows of a range came out of order")
                    o.seek(len(heads[1]) + kind.itemsize * (bag + seen.get(r, 0) + 1))
                    o.write((at + np.cumsum(size[own])).astype(kind).tobytes())
                    p.seek(len(heads[0]) + 4 * dimension * at)
                    p.write(numbers[dimension * begin[own[0]] : dimension * begin[own[-1] + 1]].tobytes())
                    seen[r] = seen.get(r, 0) + len(own)
                    at += int(size[own].sum())
            p.flush()
            os.fsync(p.fileno())
            o.flush()
            os.fsync(o.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([sum(seen.values())])], names=["rows"])

    seen: dict[int, int] = {}
    try:
        # one task reads a whole range, in order
        dealt = rows.repartitionById(max(1, len(sizes)), F.col("range")).sortWithinPartitions("range", "nth")
        dealt.select("vecs", "range", "nth").mapInArrow(write, "rows long").write.format("noop").mode("overwrite").save()
        for new, old in zip(made, targets, strict=True):
            os.replace(new, old)
    finally:
        for path in made:
            if os.path.exists(path):
                os.remove(path)
    place = F.create_map(*[F.lit(x) for r, (n, _, least) in first.items() for x in (r, n - least)]) if first else F.lit(None)
    return rows.select("id", (F.col("nth") + place[F.col("range")] if first else F.lit(0)).cast("long").alias("place"))

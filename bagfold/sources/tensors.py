"""Stored tensor files (a zip with a pickle and raw storages), read without the library that wrote them.

The pickle says which tensors there are; it is read once, in one task, by an unpickler that knows a handful of names and refuses all others, so that a file can't run
anything. It yields a table of where each tensor's numbers lie in the file, and the tasks read those ranges: no task holds the file. A list of matrices are
bags, one matrix is a table of single vectors. ``ensure_packed`` converts a file to packed NumPy files where these are missing; they appear whole or not at all.
The path must be one that Python opens on the executors (a shared mount).
"""

from __future__ import annotations

import io
import os
import pickle
import struct
import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, ship, shuffle_width
from .arrays import load_packed, save_packed

# Names of storages in such files, and what their numbers are.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "BFloat16Storage": "bf16"}
#: Numbers (about) of one row of the table of ranges.
RANGE_NUMBERS = 1 << 20

RANGE = "bag long, first long, rows long, width long, at long, row_step long, step long, kind string"


@dataclass
class _Storage:
    key: str
    kind: str


@dataclass
class _Tensor:
    storage: _Storage
    offset: int
    size: tuple[int, ...]
    stride: tuple[int, ...]


def _rebuilt(storage, offset, size, stride, *_ignored) -> _Tensor:
    if not isinstance(storage, _Storage) or len(size) != len(stride) or any(not isinstance(x, int) or x < 0 for x in (offset, *size, *stride)):
        raise pickle.UnpicklingError("not a tensor")
    return _Tensor(storage, offset, tuple(size), tuple(stride))


class _Unpickler(pickle.Unpickler):
    """Knows tensors, their storages and ordered dicts; everything else is refused."""

    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _rebuilt
        if module == "torch" and name in STORAGES:
            return name
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in a tensor file")

    def persistent_load(self, pid):
        if not (isinstance(pid, tuple) and len(pid) >= 3 and pid[0] == "storage" and pid[1] in STORAGES and isinstance(pid[2], str)):
            raise pickle.UnpicklingError("not a storage")
        return _Storage(pid[2], STORAGES[pid[1]])


def tensors_of(path: str) -> tuple[list[_Tensor], bool, dict[str, tuple[int, int]]]:
    """The file's tensors, whether they came as a list, and (place in the file, bytes) of each storage."""
    with zipfile.ZipFile(path) as z, open(path, "rb") as raw:
        members = {i.filename: i for i in z.infolist()}
        inner = [n for n in members if n.count("/") == 1 and n.endswith("/data.pkl")]
        if len(inner) != 1:
            raise ValueError(f"{path} isn't a tensor file")
        root = inner[0].removesuffix("data.pkl")
        if root + "byteorder" in members and z.read(root + "byteorder") != b"little":
            raise ValueError(f"{path} isn't little-endian")
        out = _Unpickler(io.BytesIO(z.read(inner[0]))).load()
        places = {}
        for name, info in members.items():
            if name.startswith(f"{root}data/"):
                if info.compress_type != zipfile.ZIP_STORED:
                    raise ValueError(f"{path} has compressed storages")
                raw.seek(info.header_offset + 26)
                a, b = struct.unpack("<HH", raw.read(4))
                places[name.removeprefix(f"{root}data/")] = (info.header_offset + 30 + a + b, info.file_size)
    many = isinstance(out, list | tuple)
    tensors = list(out) if many else [out]
    if not all(isinstance(t, _Tensor) for t in tensors):
        raise ValueError(f"{path} holds something else than a tensor or a list of tensors")
    return tensors, many, places


def _bytes(kind: str) -> int:
    return 2 if kind == "bf16" else np.dtype(kind).itemsize


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    if kind == "bf16":  # the upper half of a 32-bit number
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(raw, kind).astype(np.float32)


def _ranges(path: str, want_list: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                tensors, many, places = tensors_of(path)
                if many != want_list:
                    raise ValueError(f"{path} holds " + ("a list of tensors" if many else "one tensor"))
                rows = []
                for bag, t in enumerate(tensors):
                    if len(t.size) != 2:
                        raise ValueError(f"{path}: tensor {bag} has {len(t.size)} dimensions")
                    n, width = t.size
                    at, size = places[t.storage.key]
                    number = _bytes(t.storage.kind)
                    last = t.offset + max(n - 1, 0) * t.stride[0] + max(width - 1, 0) * t.stride[1]
                    if n and width and (last + 1) * number > size:
                        raise ValueError(f"{path}: tensor {bag} reaches beyond its storage")
                    step = max(1, RANGE_NUMBERS // max(1, width))
                    for lo in range(0, n, step) if n else [0]:
                        rows.append((bag, lo, min(step, n - lo), width, at + number * (t.offset + lo * t.stride[0]), number * t.stride[0], number * t.stride[1], t.storage.kind))
                    if len(rows) >= 65_536:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RANGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kind" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def _read(f, at: int, n: int, width: int, row_step: int, step: int, kind: str) -> np.ndarray:
    """``n`` rows of a tensor, whatever its strides."""
    if not n or not width:
        return np.zeros((n, width), np.float32)
    number = _bytes(kind)
    f.seek(at)
    flat = _numbers(f.read((n - 1) * row_step + (width - 1) * step + number), kind)
    return flat[np.arange(n)[:, None] * (row_step // number) + np.arange(width) * (step // number)]


def _loaded(spark: SparkSession, path: str, want_list: bool) -> DataFrame:
    ship(spark)
    found = materialize(spark.range(1).select("id").coalesce(1).mapInArrow(_ranges(path, want_list), RANGE), "tensors")
    return found.repartition(shuffle_width(spark), "bag", "first")


def load_bags(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """(id, vecs) of a file with a list of matrices; ids are their places from 0. Bags of several ranges are put together again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    if dimension is not None and r["width"] != dimension:
                        raise ValueError(f"vectors must have {dimension} numbers")
                    x = _read(f, r["at"], r["rows"], r["width"], r["row_step"], r["step"], r["kind"])
                    yield pa.RecordBatch.from_arrays([pa.array([r["bag"]]), pa.array([r["first"]]), pa.array([x.tolist()], pa.list_(pa.list_(pa.float32())))], names=["id", "first", "vecs"])

    parts = _loaded(spark, path, True).mapInArrow(run, "id long, first long, vecs array<array<float>>")
    return parts.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first", "vecs"))), lambda x: x["vecs"])).alias("vecs"))


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, sv) of a file with one matrix; ids are the rows' places from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    x = _read(f, r["at"], r["rows"], r["width"], r["row_step"], r["step"], r["kind"])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(r["first"], r["first"] + len(x))), flat], names=["id", "sv"])

    return _loaded(spark, path, False).mapInArrow(run, "id long, sv array<float>")


def ensure_packed(spark: SparkSession, points: str, offsets: str, tensors: str, dimension: int) -> DataFrame:
    """The packed bags of two NumPy files, which are made from a tensor file first if one is missing."""
    if not (os.path.exists(points) and os.path.exists(offsets)):
        if not os.path.exists(tensors):
            raise FileNotFoundError(f"neither {points} and {offsets} nor {tensors} exist")
        save_packed(load_bags(spark, tensors, dimension), points, offsets, dimension)
    return load_packed(spark, points, offsets, dimension)

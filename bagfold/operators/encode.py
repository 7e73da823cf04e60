"""Fixed-size encodings of bags.

``encode`` takes the bag table and works row by row in Arrow batches: one matrix product sketches all vectors of a batch,
sorted bucket numbers are summed by reduction, and no row leaves its partition. ``encode_tokens`` takes the token table and
uses column expressions only: partial and final aggregation on (id, rep, part, i). Both give the same numbers; an absent bucket is zero.

A bag without vectors is the zero vector (or is dropped on request). Sums are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EncoderConfig, Encoding, FillTarget
from ..functions import randmat, sketch
from ..runtime import ship


#: A step along an axis of the bit cube, above any place in a bag; and a distance beyond all.
_FARTHER, _NOWHERE = 1 << 40, 1 << 62


class Encoder:
    """Matrices of the chosen repetitions and the encoding of NumPy bags."""

    def __init__(self, config: EncoderConfig, reps: list[int] | None = None):
        self.config, self.reps = config, config.chosen(reps)
        self.planes = np.concatenate([randmat.hyperplanes(config, r).astype(float) for r in self.reps], axis=1)
        self.projections = [randmat.projection_matrix(config, r) for r in self.reps]

    def bits(self, points: np.ndarray) -> np.ndarray:
        """points x repetitions: the positive sketches as numbers, first plane highest."""
        k = self.config.bits
        hot = (points.astype(float) @ self.planes > 0).reshape(len(points), len(self.reps), k)
        return hot.astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else np.zeros((len(points), len(self.reps)), np.int64)

    def parts(self, bits: np.ndarray) -> np.ndarray:
        out, shift = bits.copy(), 1
        while shift < max(self.config.bits, 1):
            out ^= out >> shift
            shift *= 2
        return out

    def encode(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bags ``points[offsets[i]:offsets[i+1]]`` -> dense (bags, reps, buckets, width), counts (bags, reps, buckets), vectors' buckets."""
        c, n = self.config, len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        bits = self.bits(points)
        parts = self.parts(bits)
        out = np.zeros((n, len(self.reps), c.buckets, c.width))
        counts = np.zeros((n, len(self.reps), c.buckets), np.int64)
        wide = points.astype(float)
        for j in range(len(self.reps)):
            projected = wide @ self.projections[j]
            slot = owner * c.buckets + parts[:, j]
            counts[:, j] = np.bincount(slot, minlength=n * c.buckets).reshape(n, c.buckets)
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.diff(slot[order], prepend=-1))
            if len(first):
                flat = out[:, j].reshape(n * c.buckets, c.width).copy()
                flat[slot[order][first]] = np.add.reduceat(projected[order], first, axis=0)
                out[:, j] = flat.reshape(n, c.buckets, c.width)
            if c.encoding is Encoding.AVERAGE:
                out[:, j] /= np.maximum(counts[:, j], 1)[:, :, None]
                if c.fill_empty:
                    self._fill(out[:, j], counts[:, j], projected, bits[:, j], offsets)
        return out, counts, parts

    def _fill(self, out: np.ndarray, counts: np.ndarray, projected: np.ndarray, bits: np.ndarray, offsets: np.ndarray) -> None:
        """An empty bucket takes its bag's vector of least bit distance, the first of equals.

        Each corner of the bit cube starts with its first vector; a sweep along every axis then leaves the nearest one everywhere, by distance and place.
        """
        n, every = len(counts), np.arange(self.config.buckets)
        aim = every ^ (every >> 1) if self.config.fill_target is FillTarget.INVERSE else self.parts(every)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        place = np.arange(len(bits)) - offsets[owner]
        near = np.full((n, self.config.buckets), _NOWHERE, np.int64)
        corner, first = np.unique(owner * self.config.buckets + bits, return_index=True)
        near.ravel()[corner] = place[first]
        for j in range(self.config.bits):
            pair = near.reshape(n, -1, 2, 1 << j)
            np.minimum(pair, pair[:, :, ::-1] + _FARTHER, out=pair)
        bag, part = np.nonzero((counts == 0) & (np.diff(offsets) > 0)[:, None])
        out[bag, part] = projected[offsets[bag] + (near[bag, aim[part]] & (_FARTHER - 1))]

    def encode_counted(self, look: tuple[np.ndarray, list[np.ndarray]], which: np.ndarray, times: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bags of dictionary vectors with multiplicities -> dense (bags, reps, buckets, width); ``look`` is ``looked_up``."""
        c, n = self.config, len(offsets) - 1
        parts, projected = look
        owner = np.repeat(np.arange(n), np.diff(offsets))
        out = np.zeros((n, len(self.reps), c.buckets, c.width))
        for j in range(len(self.reps)):
            slot = owner * c.buckets + parts[which, j]
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.diff(slot[order], prepend=-1))
            if len(first):
                flat = np.zeros((n * c.buckets, c.width))
                flat[slot[order][first]] = np.add.reduceat(projected[j][which[order]] * times[order, None], first, axis=0)
                if c.encoding is Encoding.AVERAGE:
                    flat /= np.maximum(np.bincount(slot, times, n * c.buckets), 1)[:, None]
                out[:, j] = flat.reshape(n, c.buckets, c.width)
        return out

    def looked_up(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Buckets and projections of dictionary vectors, worked out once for all bags."""
        wide = vectors.astype(float)
        return self.parts(self.bits(vectors)), [wide @ p for p in self.projections]

    def final(self, dense: np.ndarray) -> np.ndarray:
        """The flat vectors, after the final count sketch if there is one."""
        flat = dense.reshape(len(dense), -1)
        if self.config.final_dimension is None:
            return flat
        target, sign = randmat.signed_targets(flat.shape[1], self.config.final_dimension, self.config.seed)
        order = np.argsort(target, kind="stable")
        first = np.flatnonzero(np.diff(target[order], prepend=-1))
        out = np.zeros((len(flat), self.config.final_dimension))
        out[:, target[order][first]] = np.add.reduceat((flat * sign)[:, order], first, axis=1)
        return out


def bag_arrays(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and offsets of an Arrow column of bags; null bags are empty."""
    size = np.where(np.asarray(column.is_valid()), np.diff(np.asarray(column.offsets)), 0)  # flatten() leaves out what a null bag may hold
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    flat = column.flatten()
    widths = np.diff(np.asarray(flat.offsets)) if len(flat) else np.zeros(0)
    if len(flat) and not (widths == dimension).all():
        raise ValueError(f"vectors must have {dimension} numbers")
    points = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) if len(flat) else np.zeros((0, dimension))
    return points, off


def float_lists(rows: np.ndarray) -> pa.Array:
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def rows_at_once(config: EncoderConfig, reps: int) -> int:
    """Bags encoded together, so that the dense result stays near 64 MB."""
    return max(1, (8 << 20) // max(1, config.block * reps))


def encode(bags: DataFrame, config: EncoderConfig, reps: list[int] | None = None, kind: str | None = None, without_empty: bool = False) -> DataFrame:
    """(id, fde, sizes): the flat encoding and, for each repetition and bucket, its count of vectors.

    ``kind`` "query" sums and rejects filling, "document" averages; None takes the configuration as it is.
    """
    if kind not in (None, "query", "document"):
        raise ValueError("kind must be query, document or None")
    config = config.for_queries() if kind == "query" else config.for_documents(config.fill_empty) if kind == "document" else config
    reps = config.chosen(reps)
    ship(bags.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = Encoder(config, reps), rows_at_once(config, len(reps))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                points, off = bag_arrays(part.column(1), config.dimension)
                dense, counts, _ = encoder.encode(points, off)
                yield pa.RecordBatch.from_arrays([part.column(0), float_lists(encoder.final(dense)), float_lists(counts.reshape(len(counts), -1).astype(np.int32))], names=["id", "fde", "sizes"])

    rows = bags.select("id", "vecs")
    if without_empty:
        rows = rows.filter(F.size("vecs") > 0)
    return rows.mapInArrow(run, f"id {dict(bags.dtypes)['id']}, fde array<double>, sizes array<int>")


def sketched(tokens: DataFrame, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """Tokens with rep, rep_pos, value (bits as a number), part and the other label.

    The planes are a table of fixed size (one row a repetition), so they are broadcast.
    """
    planes = F.broadcast(randmat.planes_frame(tokens.sparkSession, config, reps))
    out = tokens.crossJoin(planes)
    value = sketch.bits_value(sketch.plane_bits(F.col("vec"), F.col("planes")))
    out = out.withColumn("value", value.cast("int"))
    return out.withColumn("part", sketch.prefix_xor(F.col("value"), config.bits).cast("int")).withColumn("label", sketch.alternative_label(F.col("vec"), F.col("planes"))).drop("planes")


def partition_counts(tokens: DataFrame, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """(id, rep, part, cnt); an absent row is a count of 0."""
    return sketched(tokens, config, reps).groupBy("id", "rep", "part").agg(F.count("*").alias("cnt"))


def _projected(tokens: DataFrame, config: EncoderConfig, reps: list[int] | None) -> DataFrame:
    """(…, target, x): the numbers of each projected vector, signed and with the place they are summed in."""
    targets = F.broadcast(randmat.targets_frame(tokens.sparkSession, config, reps))
    keep = [c for c in tokens.columns if c != "vec"]
    return tokens.select(*keep, F.posexplode("vec").alias("i", "x")).join(targets, ["rep", "i"]).withColumn("x", F.col("x").cast("double") * F.col("sign")).drop("i", "sign")


def encode_tokens(tokens: DataFrame, config: EncoderConfig, reps: list[int] | None = None, kind: str | None = None) -> DataFrame:
    """(id, rep, part, i, value): the encoding in long form; absent numbers are 0."""
    if kind == "query":
        config = config.for_queries()
    average = kind == "document" or (kind is None and config.encoding is Encoding.AVERAGE)
    marked = sketched(tokens, config, reps).select("id", "rep", "part", "vec")
    sums = _projected(marked, config, reps).groupBy("id", "rep", "part", F.col("target").alias("i")).agg(F.sum("x").alias("value"))
    if average:
        counts = marked.groupBy("id", "rep", "part").agg(F.count("*").alias("cnt"))
        sums = sums.join(counts, ["id", "rep", "part"]).withColumn("value", F.col("value") / F.col("cnt"))
    out = sums.select("id", "rep", "part", "i", "value")
    if average and config.fill_empty:
        out = out.unionByName(filled(tokens, config, reps))
    return out


def filled(tokens: DataFrame, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """Numbers of the empty buckets of every bag: those of the nearest vector by bits, the first of equals.

    A bag's corners of the bit cube are one array for a repetition, swept along every axis; the vectors come in at the end, by their places.
    """
    marked = sketched(tokens, config, reps).select("id", "rep", "pos", "value", "part")
    corners = marked.groupBy("id", "rep", "value", "part").agg(F.min("pos").cast("long").alias("first"))
    bags = corners.groupBy("id", "rep").agg(F.map_from_entries(F.collect_list(F.struct("value", "first"))).alias("first"), F.collect_set("part").alias("parts"))
    every = F.sequence(F.lit(0), F.lit(config.buckets - 1))
    start = F.transform(every, lambda b: F.coalesce(F.col("first")[b], F.lit(_NOWHERE)))
    step = lambda near, j: F.transform(near, lambda x, b: F.least(x, F.get(near, b.bitwiseXOR(F.call_function("shiftleft", F.lit(1), j))) + F.lit(_FARTHER)))
    near = F.aggregate(F.sequence(F.lit(0), F.lit(config.bits - 1)), start, step) if config.bits else start
    bags = bags.select("id", "rep", near.alias("near"), F.explode(F.array_except(every, "parts")).alias("part"))
    aim = F.col("part").bitwiseXOR(F.shiftright("part", 1)) if config.fill_target is FillTarget.INVERSE else sketch.prefix_xor(F.col("part"), config.bits).cast("int")
    nearest = bags.select("id", "rep", "part", F.get("near", aim).bitwiseAND(F.lit(_FARTHER - 1)).alias("pos")).join(tokens.select("id", F.col("pos").cast("long").alias("pos"), "vec"), ["id", "pos"])
    return _projected(nearest.select("id", "rep", "part", "vec"), config, reps).groupBy("id", "rep", "part", F.col("target").alias("i")).agg(F.sum("x").alias("value"))


def count_sketched(long: DataFrame, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """(id, i, value): the final count sketch of a long encoding."""
    if config.final_dimension is None:
        raise ValueError("there is no final_dimension")
    chosen = config.chosen(reps)
    target, sign = randmat.signed_targets(len(chosen) * config.block, config.final_dimension, config.seed)
    rows = [(r, int(x // config.width), int(x % config.width), int(target[j * config.block + x]), float(sign[j * config.block + x])) for j, r in enumerate(chosen) for x in range(config.block)]
    moves = long.sparkSession.createDataFrame(rows, "rep int, part int, i int, target int, sign double")
    return long.join(F.broadcast(moves), ["rep", "part", "i"]).groupBy("id", F.col("target").alias("i")).agg(F.sum(F.col("value") * F.col("sign")).alias("value"))


def to_long(encoded: DataFrame, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """(id, rep, part, i, value) of flat encodings without a final sketch; zeros are left out."""
    chosen = F.array(*[F.lit(r) for r in config.chosen(reps)])
    flat = encoded.select("id", F.posexplode("fde").alias("at", "value")).filter("value <> 0")
    rep = F.element_at(chosen, (F.floor(F.col("at") / config.block) + 1).cast("int"))
    part = F.floor((F.col("at") % config.block) / config.width).cast("int")
    return flat.select("id", rep.alias("rep"), part.alias("part"), (F.col("at") % config.width).cast("int").alias("i"), "value")

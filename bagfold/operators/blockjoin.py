"""Exact maximum inner product search as one join of query rows with blocks of documents.

Documents are written once and dealt into cells of bounded size, each a partition of its own. Every query is sent to each cell that it has to see; there the
cell's documents come first and are held as one matrix, and the queries stream past it, a batch at a time. Each cell gives the k best of a query, and these lists are
merged in two steps, so that neither the driver nor any task holds all queries, and documents are read once however many queries there are.

With ``prune`` cells are ranges of falling norm. All queries first see the cells of the largest norms, as many as hold k documents; then cells come in waves, each ``WAVE`` times as many as before. A query's k-th
score so far is its floor, and by Cauchy and Schwarz it goes only to cells whose largest norm times its own can reach the floor. Within a cell the same holds for blocks of ``BLOCK`` documents,
under a floor that rises as the blocks go by. The result is the same. Equal scores rank by id.

Nulls and defects: rows with a null vector find nothing and aren't found; repeated ids are hits of their own; there are never more hits than documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sketch
from ..runtime import materialize, ship, shuffle_width
from .pca import vectors_of

#: Bytes of the documents that a cell holds as a matrix, of scores at once, and documents of a block when pruning.
CELL_BYTES, SCORE_BYTES, BLOCK = 96 << 20, 16 << 20, 256
#: Growth of the cells seen from wave to wave when pruning.
WAVE = 4
#: Cells whose lists are merged at once; more are merged by lots first.
MERGED = 64

Load = Callable[[pa.RecordBatch], np.ndarray]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(qid, did, rank from 1, score): the k best of each query."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "did", "rank", "score")


def merged(hits: DataFrame, k: int, cells: int) -> DataFrame:
    """``ranked`` over the lists of many cells, in two steps."""
    if cells > MERGED:
        lots = Window.partitionBy("qid", "lot").orderBy(F.desc("score"), "did")
        hits = hits.withColumn("lot", F.col("cell") % math.isqrt(cells)).withColumn("place", F.row_number().over(lots)).filter(F.col("place") <= k)
    return ranked(hits.select("qid", "did", "score"), k)


def k_best(scores: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row (rows in order); equal scores by ``rank`` (of each place)."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, 1)[:, n - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), max(n, 1))
    order = np.lexsort((rank[row, col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = (np.arange(len(row)) - first < k) & (scores[row, col] > -np.inf)
    return row[keep], col[keep]


class Cell:
    """Documents of a cell. ``products`` counts the pairs that were multiplied."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, prune: bool, digits: int | None):
        self.k, self.prune, self.digits, self.products = k, prune, digits, 0
        norm = np.linalg.norm(matrix, axis=1)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.argsort(-norm, kind="stable") if prune else np.arange(len(ids))
        self.ids, self.matrix, self.norm, self.rank = ids.take(pa.array(order)), matrix[order], norm[order], rank[order]

    def search(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the best k that reach the query's floor."""
        n = len(self.ids)
        step = BLOCK if self.prune else max(self.k, SCORE_BYTES // (8 * max(len(queries), 1)))
        size = np.linalg.norm(queries, axis=1)
        best = np.full((len(queries), self.k), -np.inf)
        place = np.full((len(queries), self.k), -1)
        alive = np.arange(len(queries))
        for lo in range(0, n, step):
            if self.prune:
                # a little more than the bound, for rounding
                reach = size[alive] * self.norm[lo] * (1 + 1e-9) + 1e-12
                alive = alive[reach >= np.maximum(floor[alive], best[alive, -1])]
                if not len(alive):
                    break
            part = self.matrix[lo : lo + step]
            scores = queries[alive] @ part.T
            if self.digits is not None:
                scores = np.round(scores, self.digits)
            self.products += scores.size
            both = np.concatenate([best[alive], scores], 1)
            where = np.concatenate([place[alive], np.broadcast_to(np.arange(lo, lo + len(part)), scores.shape)], 1)
            row, col = k_best(both, self.rank[where], self.k)
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            best[alive], place[alive] = -np.inf, -1
            best[alive[row], nth], place[alive[row], nth] = both[row, col], where[row, col]
        q, nth = np.nonzero(place >= 0)
        score = best[q, nth]
        keep = score >= floor[q]
        return q[keep], place[q, nth][keep], score[keep]


def stream_cells(rows: Iterator[pa.RecordBatch], hold: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], close: Callable[[object, int], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by cell and kind (the first columns): ``hold`` makes a cell from its documents (kind 0), ``answer`` serves its queries, ``close`` ends it."""
    now, cell, kept = None, None, []
    for batch in rows:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            part, (own, kind) = batch.slice(lo, hi - lo), divmod(int(key[lo]), 2)
            if own != now:
                if cell is not None:
                    yield from close(cell, now)
                now, cell, kept = own, None, []
            if kind == 0:
                kept.append(part)
            elif kept or cell is not None:
                if cell is None:
                    cell, kept = hold(pa.Table.from_batches(kept)), []
                yield from answer(cell, part)
    if cell is not None:
        yield from close(cell, now)


def arrow_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


def _run(payload: list[str], load: Load, ask: Load | None, k: int, prune: bool, digits: int | None, q_type: str, d_type: str):
    names = ["qid", "did", "score", "cell", "products"]

    def batch(q, d, score, cell, products) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([q, d, pa.array(score, pa.float64()), pa.array(cell, pa.int64()), pa.array(products, pa.int64())], names=names)

    def hold(table: pa.Table) -> Cell:
        table = table.combine_chunks()
        part = table.select(payload).to_batches()[0]
        return Cell(table.column("did").combine_chunks(), load(part), k, prune, digits)

    def answer(cell: Cell, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        floor = part.column(part.schema.get_field_index("floor")).fill_null(-np.inf).to_numpy()
        step = max(1, SCORE_BYTES // (8 * min(max(len(cell.ids), 1), BLOCK if prune else 1 << 30)))
        for lo in range(0, part.num_rows, step):
            few = part.slice(lo, step)
            queries = vectors_of(few.column(few.schema.get_field_index("qvec"))) if ask is None else ask(few.select(payload))
            q, d, score = cell.search(queries, floor[lo : lo + step])
            if len(q):
                yield batch(part.column(part.schema.get_field_index("qid")).take(pa.array(q + lo)), cell.ids.take(pa.array(d)), score, np.full(len(q), part.column(0)[0].as_py()), pa.nulls(len(q), pa.int64()))

    def close(cell: Cell, number: int) -> Iterator[pa.RecordBatch]:
        yield batch(pa.nulls(1, arrow_type(q_type)), pa.nulls(1, arrow_type(d_type)), [None], [number], [cell.products])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_cells(batches, hold, answer, close)

    return run


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return vectors_of(batch.column(0))


def _joined(documents: DataFrame, asked: DataFrame, cells: int, load: Load, k: int, prune: bool, digits: int | None, ask: Load | None = None) -> DataFrame:
    """(qid, did, score, cell, products) of ``documents`` (cell, did, payload) and ``asked`` (cell, qid, qvec, floor): hits, and one row a cell with its products.

    With ``ask`` the queries have a payload of the same columns in place of qvec, of which it makes vectors.
    """
    payload = [c for c in documents.columns if c not in ("cell", "did")]
    q_type, d_type = dict(asked.dtypes)["qid"], dict(documents.dtypes)["did"]
    none = {c: F.lit(None).cast(t) for c, t in [*asked.dtypes, *documents.dtypes] if c != "cell"}
    columns = ["did", *payload, "qid", *(["qvec"] if ask is None else []), "floor"]
    docs = documents.select("cell", F.lit(0).alias("kind"), *(F.col(c) if c in documents.columns else none[c].alias(c) for c in columns))
    both = docs.unionByName(asked.select("cell", F.lit(1).alias("kind"), *(F.col(c) if c in asked.columns else none[c].alias(c) for c in columns)))
    both = both.repartitionById(cells, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")
    return both.mapInArrow(_run(payload, load, ask, k, prune, digits, q_type, d_type), f"qid {q_type}, did {d_type}, score double, cell long, products long")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter("vec is not null").select("qid", F.col("vec").cast("array<double>").alias("qvec"), F.lit(None).cast("double").alias("floor"))


def cell_count(documents: DataFrame, row_bytes: int) -> int:
    n = documents.count()
    return max(1, min(n, max(shuffle_width(documents.sparkSession), -(-n * row_bytes // CELL_BYTES))))


def block_join(queries: DataFrame, documents: DataFrame, k: int, row_bytes: int, load: Load | None = None, digits: int | None = None, ask: Load | None = None) -> DataFrame:
    """The best k of ``documents`` (did, and what ``load`` makes vectors of) for each of ``queries`` (qid, vec; or qid, and what ``ask`` makes vectors of). ``digits`` rounds scores, so that copies tie."""
    ship(documents.sparkSession)
    docs = materialize(documents.filter("vec is not null") if load is None else documents, "searched")
    cells = cell_count(docs, row_bytes)
    dealt = docs.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("long"))
    asked = _asked(queries) if ask is None else queries.withColumn("floor", F.lit(None).cast("double"))
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("cell", F.col("cell").cast("long"))
    hits = _joined(dealt, asked, cells, load or _vectors, k, False, digits, ask).filter("products is null")
    return merged(hits, k, cells)


@dataclass
class Pruned:
    """Hits (qid, did, rank, score) and how many of the products of all pairs were made."""

    hits: DataFrame
    made: int
    all: int


def pruned(queries: DataFrame, documents: DataFrame, k: int, cell_rows: int | None = None) -> Pruned:
    """``block_join`` of vectors (did, vec) with bounds; worth it where norms differ. ``cell_rows`` sets the documents of a cell."""
    spark = documents.sparkSession
    ship(spark)
    docs = materialize(documents.filter("vec is not null").select("did", F.col("vec").cast("array<double>").alias("vec"), sketch.norm(F.col("vec")).alias("norm")), "searched")
    asked = materialize(_asked(queries), "asked")
    n, many = docs.count(), asked.count()
    first = docs.first()
    if first is None or not many:
        return Pruned(ranked(spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, did {dict(documents.dtypes)['did']}, score double"), k), 0, n * many)
    cells = max(1, -(-n // cell_rows)) if cell_rows else cell_count(docs, 8 * len(first.vec))
    ordered = docs.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(cells, F.desc("norm"), "tie").withColumn("cell", F.spark_partition_id().cast("long"))
    ordered = materialize(ordered.select("cell", "did", "vec", "norm"), "by-norm")
    most, first, held = {}, [], 0
    for r in sorted(ordered.groupBy("cell").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect(), key=lambda r: r.cell):  # one row a cell
        most[r.cell] = r.most
        if held < k:
            held, first = held + r.n, [*first, r.cell]
    order = sorted(most)
    lo, hi, made, best = 0, len(first), 0, None
    while lo < len(order):
        now = order[lo:hi]
        if best is None:
            sent = asked.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(now) - 1))))
        else:
            floors = best.filter(F.col("rank") == k).groupBy("qid").agg(F.min("score").alias("floor"))
            wide = asked.drop("floor").join(floors, "qid", "left").select("qid", "qvec", "floor")
            reach = wide.mapInArrow(_reaching(spark.sparkContext.broadcast(np.array([most[c] for c in now]))), f"qid {dict(asked.dtypes)['qid']}, qvec array<double>, floor double, cells int").filter("cells > 0")
            sent = materialize(reach.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells"), "sent")
            if sent.isEmpty():
                break  # norms only fall from here on
        number = F.element_at(F.array(*[F.lit(c).cast("long") for c in now]), F.col("place") + 1)
        hits = materialize(_joined(ordered.filter(F.col("cell").between(now[0], now[-1])).drop("norm"), sent.withColumn("cell", number).drop("place"), cells, _vectors, k, True, None), "wave")
        made += hits.agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0]
        hits = merged(hits.filter("products is null"), k, len(now))
        best = materialize(hits if best is None else ranked(best.drop("rank").unionByName(hits.drop("rank")), k), "best")
        lo, hi = hi, WAVE * hi
    return Pruned(best, made, n * many)


def _reaching(bounds):
    """Appends how many of the next cells, whose largest norms fall, a query (qid, qvec, floor) has to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rising = bounds.value[::-1]
        for b in batches:
            if not b.num_rows:
                continue
            norm = np.linalg.norm(vectors_of(b.column(1)), axis=1)
            need = b.column(2).fill_null(-np.inf).to_numpy()
            # a little less than the bound, for rounding; a query without a floor, or with one that isn't positive, sees all
            least = np.where(need > 0, (need * (1 - 1e-9) - 1e-12) / np.maximum(norm, 1e-300), -np.inf)
            cells = len(rising) - np.searchsorted(rising, least)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.astype(np.int32))], names=["qid", "qvec", "floor", "cells"])

    return run

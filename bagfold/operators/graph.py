"""Approximate maximum inner product search along a neighbour graph.

Documents are dealt by hash into lots of bounded size. A lot's graph links each distinct vector with those of the largest inner products, both ways; so
vectors of large norm, which answer most queries, are linked from everywhere. The index is a table of its own, with a row a document: it is built once, saved, and
loaded by any session. A query goes to every lot and walks its graph from the vectors of largest norm: the best vector not yet left is left for its neighbours, until the
``beam`` best are all left. Only vectors that the walk meets are multiplied; ``Found.made`` counts them. The lots' lists are merged in two steps.

Nulls and defects: a null vector isn't indexed; equal vectors are one node and rank by id; a lot of one document is found by every query. An index of no documents
can't be built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from . import search
from .pca import vectors_of

#: Documents (about) of a lot, neighbours by inner product and from the other side, places where a walk starts, and vectors that it keeps.
LOT_ROWS, NEIGHBOURS, BACK, STARTS, BEAM = 8192, 16, 16, 16, 20
#: Bytes of products at once while a graph is built.
PRODUCT_BYTES = 64 << 20


@dataclass
class Found:
    """Hits (qid, did, rank, score), and how many of the products of all pairs were made."""

    hits: DataFrame
    made: int
    all: int


def neighbours(x: np.ndarray, many: int = NEIGHBOURS, back: int = BACK) -> np.ndarray:
    """For each row of ``x`` the rows of largest inner product, and of those that hold it so, the ones of largest norm; -1 pads."""
    n = len(x)
    many = min(many, n - 1)
    out = np.full((n, max(many, 0) + back), -1, np.int32)
    if many < 1:
        return out
    step = max(1, PRODUCT_BYTES // (8 * n))
    for lo in range(0, n, step):
        s = x[lo : lo + step] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + step, :many] = np.argpartition(-s, many - 1, 1)[:, :many]
    source, target = np.repeat(np.arange(n), many), out[:, :many].ravel().astype(np.int64)
    known = np.isin(target * n + source, source * n + target)  # links that go both ways already
    source, target = source[~known], target[~known]
    order = np.lexsort((source, -np.linalg.norm(x, axis=1)[source], target))
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    out[target[nth < back], many + nth[nth < back]] = source[nth < back]
    return out


class Lot:
    """A lot's documents (in order of their rows) with their nodes; ``products`` counts what walks have multiplied."""

    def __init__(self, ids: pa.Array, node: np.ndarray, matrix: np.ndarray, links: np.ndarray, k: int, beam: int, starts: int):
        self.k, self.beam, self.products = k, max(beam, k), 0
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, node))
        self.ids, self.first = ids.take(pa.array(order)), np.searchsorted(node[order], np.arange(len(matrix) + 1))
        self.rank, self.matrix, self.links = rank[order], matrix, links
        self.starts = np.argsort(-np.linalg.norm(matrix, axis=1), kind="stable")[:starts]

    def search(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the best k that the walks meet."""
        many, n = len(queries), len(self.matrix)
        seen = np.zeros((many, n + 1), bool)  # the last column stands for no neighbour
        seen[:, n] = True
        seen[:, self.starts] = True
        width = max(self.beam, len(self.starts))
        score, node, left = np.full((many, width), -np.inf), np.full((many, width), n), np.ones((many, width), bool)
        score[:, : len(self.starts)], node[:, : len(self.starts)], left[:, : len(self.starts)] = queries @ self.matrix[self.starts].T, self.starts, False
        self.products += many * len(self.starts)
        score, node, left = self._best(score, node, left)
        going = np.arange(many)
        while len(going):
            open_ = np.where(left[going], -np.inf, score[going])
            at = open_.argmax(1)
            still = open_[np.arange(len(going)), at] > -np.inf
            going, at = going[still], at[still]
            if not len(going):
                break
            left[going, at] = True
            near = self.links[node[going, at]].astype(np.int64)
            near[near < 0] = n
            new = ~seen[going[:, None], near]
            row, col = np.nonzero(new)
            seen[going[row], near[row, col]] = True
            value = np.full(near.shape, -np.inf)
            value[row, col] = np.einsum("ij,ij->i", self.matrix[near[row, col]], queries[going[row]])
            self.products += len(row)
            score[going], node[going], left[going] = self._best(np.concatenate([score[going], value], 1), np.concatenate([node[going], near], 1), np.concatenate([left[going], ~new], 1))
        return self._hits(score, node)

    def _best(self, score: np.ndarray, node: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((node, -score))[:, : self.beam]
        return tuple(np.take_along_axis(x, order, 1) for x in (score, node, left))

    def _hits(self, score: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of the nodes: of copies no more than k, those of the least ids."""
        row, col = np.nonzero(score > -np.inf)
        own = node[row, col]
        count = np.minimum(self.first[own + 1] - self.first[own], self.k)
        start = np.cumsum(count) - count
        doc = np.repeat(self.first[own] - start, count) + np.arange(int(count.sum()))
        row, value = np.repeat(row, count), np.repeat(score[row, col], count)
        order = np.lexsort((self.rank[doc], -value, row))
        row, doc, value = row[order], doc[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[keep], doc[keep], value[keep]


def _graph(batches: Iterator[pa.RecordBatch], names: list[str], many: int, back: int) -> Iterator[pa.RecordBatch]:
    """Rows (lot, did, vec), sorted by lot, with the node of each document and, at a node's first document, its links."""

    def one(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(kept).combine_chunks()
        part = table.to_batches()[0]
        x = vectors_of(part.column(2)) + 0.0  # no negative zeros
        key = np.ascontiguousarray(x).view([("", np.void, x.shape[1] * 8)]).ravel() if x.shape[1] else np.zeros(len(x))
        _, first, node = np.unique(key, return_index=True, return_inverse=True)
        links = neighbours(x[first], many, back)
        flat, off = links.ravel(), np.zeros(len(x) + 1, np.int32)
        off[first + 1] = links.shape[1]
        order = np.argsort(first)
        column = pa.ListArray.from_arrays(pa.array(np.cumsum(off, dtype=np.int32)), pa.array(flat.reshape(links.shape)[order].ravel()))
        yield from pa.Table.from_arrays([*part.columns, pa.array(node.astype(np.int32)), column], names=names).to_batches(max_chunksize=1024)

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        lot = batch.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if kept and kept[0].column(0)[0].as_py() != int(lot[lo]):
                yield from one(kept)
                kept = []
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield from one(kept)


class GraphIndex:
    """A table (cell, did, vec, node, links), saved at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        """An index that was built before."""
        self.path, self.table = path, spark.read.parquet(path)
        self.documents, self.lots = self.table.agg(F.count("*"), F.coalesce(F.max("cell"), F.lit(-1)) + 1).first()

    @staticmethod
    def build(documents: DataFrame, path: str, lot_rows: int = LOT_ROWS, many: int = NEIGHBOURS, back: int = BACK) -> GraphIndex:
        """Index ``documents`` (did, vec) at ``path``; an index that is there is replaced when the new one is whole."""
        spark = documents.sparkSession
        ship(spark)
        rows = materialize(documents.filter("vec is not null").select("did", F.col("vec").cast("array<double>").alias("vec")), "indexed")
        total = rows.count()
        if not total:
            raise ValueError("there are no documents to index")
        lots = -(-total // lot_rows)
        dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots)).cast("long").alias("cell"), "did", "vec")
        dealt = dealt.repartitionById(lots, F.col("cell").cast("int")) if lots > 1 else dealt.coalesce(1)
        names = ["cell", "did", "vec", "node", "links"]
        schema = f"cell long, did {dict(documents.dtypes)['did']}, vec array<double>, node int, links array<int>"
        dealt.sortWithinPartitions("cell").mapInArrow(lambda batches: _graph(batches, names, many, back), schema).write.mode("overwrite").parquet(path)
        return GraphIndex(spark, path)

    def search(self, queries: DataFrame, k: int, beam: int = BEAM, starts: int = STARTS) -> Found:
        """The best k of ``queries`` (qid, vec) that walks with ``beam`` find."""
        ship(queries.sparkSession)
        asked = materialize(queries.filter("vec is not null").select("qid", F.col("vec").cast("array<double>").alias("qvec")), "asked")
        to = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.lots - 1).cast("long"))))

        def hold(table: pa.Table) -> Lot:
            node, links = table.column("node").to_numpy(), table.column("links").combine_chunks()
            matrix = vectors_of(table.column("vec").combine_chunks())
            first = np.flatnonzero(np.diff(np.asarray(links.offsets)) > 0)
            order = np.argsort(node[first])  # the node's first document carries its links
            width = len(links.flatten()) // len(first)
            return Lot(table.column("did").combine_chunks(), node, matrix[first][order], links.flatten().to_numpy().reshape(len(first), width)[order], k, beam, starts)

        hits, raw = search.in_lots(self.table, to, self.lots, hold, k)
        return Found(hits, raw.agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0], asked.count() * self.documents)


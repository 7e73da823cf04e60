"""Block-wise PCA with one cut by eigenvalue over all blocks.

Fitting takes one pass: each partition sums n, x and x x' for every block; the sums meet in two steps and each block is
diagonalised where it lies. Standardising needs no second pass, as the covariance of the standardised block is D C D with C that of the
raw block and D the inverse deviations. Only the model (its size is fixed by the configuration) comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .encode import float_lists

EPS = 1e-12
GRAM = "block int, n long, s array<double>, ss array<double>"
LANES = 32


def block_slices(size: int, blocks: int) -> list[slice]:
    """Contiguous blocks; the first ``size % blocks`` are one wider."""
    if size < 1 or blocks < 1:
        raise ValueError("size and blocks must be positive")
    edge = [b * (size // blocks) + min(b, size % blocks) for b in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


@dataclass(frozen=True)
class BlockPCA:
    """``weights`` (size x kept) by falling eigenvalue; mean and std of the fitted columns."""

    weights: np.ndarray
    eigenvalues: np.ndarray
    origin: list[tuple[int, int]]
    mean: np.ndarray
    std: np.ndarray
    blocks: int

    def transform(self, x: np.ndarray) -> np.ndarray:
        if x.ndim != 2 or x.shape[1] != len(self.weights):
            raise ValueError(f"expected rows of {len(self.weights)} numbers, got {x.shape}")
        return x @ self.weights

    def transform_standardised(self, x: np.ndarray) -> np.ndarray:
        """Of ((x - mean) / (std + eps)), as one affine map of x."""
        over = self.weights / (self.std + EPS)[:, None]
        return x @ over - self.mean @ over


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def block_grams(rows: DataFrame, blocks: int, column: str = "fde") -> DataFrame:
    """GRAM: for each block the count, sums and sums of products over all rows."""
    ship(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, s, ss, cut = 0, None, None, None
        for batch in batches:
            x = vectors_of(batch.column(0))
            if not len(x):
                continue
            if s is None:
                cut = block_slices(x.shape[1], blocks)
                s, ss = np.zeros(x.shape[1]), [np.zeros((c.stop - c.start,) * 2) for c in cut]
            n += len(x)
            s += x.sum(0)
            for c, g in zip(cut, ss, strict=True):
                g += x[:, c].T @ x[:, c]
        if s is not None:
            lane = TaskContext.get().partitionId() % LANES
            for b, (c, g) in enumerate(zip(cut, ss, strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([lane], pa.int32()), pa.array([n]), pa.array([s[c]]), pa.array([g.reshape(-1)])], names=["block", "lane", "n", "s", "ss"])

    def total(table: pa.Table) -> pa.Table:
        add = lambda name: sum(np.asarray(x.values) for x in table.column(name))
        out = {"block": table.column("block")[:1].cast(pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())]), "s": pa.array([add("s")]), "ss": pa.array([add("ss")])}
        return pa.table({"block": out["block"].combine_chunks(), **{k: out[k] for k in ("n", "s", "ss")}})

    parts = rows.select(column).mapInArrow(partial, "block int, lane int, n long, s array<double>, ss array<double>")
    return parts.groupBy("block", "lane").applyInArrow(total, GRAM).groupBy("block").applyInArrow(total, GRAM)


def _eigen(standard: bool):
    def run(table: pa.Table) -> pa.Table:
        block, n = table.column("block")[0].as_py(), table.column("n")[0].as_py()
        s = np.asarray(table.column("s")[0].values)
        width = len(s)
        if n <= width:
            raise ValueError(f"block {block} has {n} samples for {width} dimensions; take more samples or fewer dimensions")
        mean = s / n
        cov = np.asarray(table.column("ss")[0].values).reshape(width, width) / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov), 0))
        if standard:
            inverse = np.where(std > 0, 1 / (std + EPS), 0.0)
            cov = cov * np.outer(inverse, inverse)
        value, vector = np.linalg.eigh(cov * (n / (n - 1)))
        order = np.argsort(-value, kind="stable")
        value, vector = np.maximum(value[order], 0.0), vector[:, order]
        vector = vector * np.where(vector[np.abs(vector).argmax(0), np.arange(width)] < 0, -1.0, 1.0)  # a sign that doesn't depend on the solver
        return pa.table({"block": pa.array([block] * width, pa.int32()), "local": pa.array(range(width), pa.int32()), "eigenvalue": value, "loading": pa.array(list(vector.T)), "mean": mean, "std": std})

    return run


def eigenpairs(rows: DataFrame, blocks: int, column: str = "fde", standardise: bool = True) -> DataFrame:
    """(block, local, eigenvalue, loading, mean, std of column ``local``) of the covariance over n - 1."""
    return block_grams(rows, blocks, column).groupBy("block").applyInArrow(_eigen(standardise), "block int, local int, eigenvalue double, loading array<double>, mean double, std double")


def fit(rows: DataFrame, blocks: int, keep: int | None = None, column: str = "fde", standardise: bool = True, sample_rate: float = 1.0, seed: int = 42) -> BlockPCA:
    """The model of ``rows`` (id, column); ``sample_rate`` under 1 fits on a seeded sample of the ids."""
    if sample_rate < 1.0:
        from ..sources.tokens import sample_ids

        rows = rows.join(sample_ids(rows.select("id"), sample_rate, seed), "id", "left_semi")
    found = eigenpairs(rows, blocks, column, standardise).orderBy("block", "local").collect()
    if not found:
        raise ValueError("there are no rows to fit on")
    width = np.bincount([r.block for r in found])
    start = np.concatenate([[0], np.cumsum(width)])
    best = sorted(found, key=lambda r: (-r.eigenvalue, r.block, r.local))[: len(found) if keep is None else min(keep, len(found))]
    weights = np.zeros((len(found), len(best)))
    for j, r in enumerate(best):
        weights[start[r.block] : start[r.block + 1], j] = r.loading
    return BlockPCA(weights, np.array([r.eigenvalue for r in best]), [(r.block, r.local) for r in best], np.array([r.mean for r in found]), np.array([r.std for r in found]), len(width))


def transform(rows: DataFrame, model: BlockPCA, column: str = "fde", out: str = "vec", standardised: bool = False) -> DataFrame:
    """(id, out) of (id, column)."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch.column(1))
                y = shared.value.transform_standardised(x) if standardised else shared.value.transform(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), float_lists(y)], names=["id", out])

    return rows.select("id", F.col(column)).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {out} array<double>")

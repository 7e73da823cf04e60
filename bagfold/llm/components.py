"""Connected components of an edge table, without gathering it anywhere.

Edges are first contracted to spanning stars within each partition (union-find over at most ``PART_EDGES`` edges or so),
then large-star and small-star steps alternate until the edges stay the same. Each round is written to the scratch folder.
Edges that fit in one partition are done after the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship

EDGE = "u long, v long"
PART_EDGES = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, by repeated hooking and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        open_ = px != py
        if not open_.any():
            return nodes, nodes[parent]
        x, y = x[open_], y[open_]
        low, high = np.minimum(px[open_], py[open_]), np.maximum(px[open_], py[open_])
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    held = 0

    def close() -> pa.RecordBatch:
        node, root = union_find(np.concatenate(a), np.concatenate(b))
        far = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["u", "v"])

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
    if held:
        yield close()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root): each node that has an edge, with the least node of its component."""
    ship(edges.sparkSession)
    a, b = edges.columns
    rows = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"), label)
    parts = 1 + rows.count() // PART_EDGES
    stars = materialize(rows.coalesce(parts).mapInArrow(_contract, EDGE), label)
    if parts == 1:
        return _named(stars)
    before = None
    while True:
        # large star: every larger neighbour moves to the least neighbour
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the least of them
        large = materialize(large.filter("u <> v").mapInArrow(_contract, EDGE).distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = materialize(small.filter("u <> v").distinct(), label)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now[0] == now[2] and before == tuple(now):
            return _named(stars)
        before = tuple(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

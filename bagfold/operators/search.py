"""Maximum inner product search.

``exact`` scores every document in one block join (``blockjoin``): no query passes through the driver, and documents are read once. ``exact_pruned`` gives the same rows and skips what
norms rule out. ``exact_sql`` is the same in column expressions: blocks of documents and queries are joined, and pairs under a query's floor go no further.
``CellIndex`` scores the documents of the cells nearest to a query: cells come from k-means on a bounded sample, after the usual step from inner product to distance. The documents lie
in a folder for each cell, so only those of probed cells are read. ``graph`` has the index whose cells are searched along a neighbour graph.
Equal scores rank by id; there are never more hits than documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sketch
from ..runtime import materialize, ship, shuffle_width
from . import blockjoin
from .blockjoin import ranked
from .pca import vectors_of

#: Documents (about) at most that k-means sees, and documents of one cell's matrix at most; a larger cell has several.
SAMPLE_ROWS, LOT_ROWS = 50_000, 32_768
#: Documents, and queries, (about) of one block of ``exact_sql``, and queries that a lot answers at once.
ARRAY_ROWS, QUERIES = 4096, 64
#: Growth of the cells searched from wave to wave in ``exact_sql``.
WAVES = 16


def _row_bytes(vectors: DataFrame) -> int:
    first = vectors.select(F.size("vec")).first()
    return 8 * max(first[0], 1) if first else 8


def exact(queries: DataFrame, documents: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The best k of ``documents`` (did, vec) for each of ``queries`` (qid, vec). ``digits`` rounds scores, so that copies tie."""
    documents = documents.select("did", F.col("vec").cast("array<double>").alias("vec"))
    return blockjoin.block_join(queries, documents, k, _row_bytes(documents), digits=digits)


def exact_pruned(queries: DataFrame, documents: DataFrame, k: int, cell_rows: int | None = None) -> blockjoin.Pruned:
    """The rows of ``exact``, with the number of products that were made and of all."""
    return blockjoin.pruned(queries, documents, k, cell_rows)


def exact_sql(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The same by column expressions: vectors are rows of numbers, and each block of documents and queries is joined where it lies.

    Documents are dealt by falling norm into cells of about ``ARRAY_ROWS``, which are searched in waves: a few documents of the first cell, its others, then ``WAVES`` times as many cells as
    before. The k-th score so far is a query's floor. It goes to the cells whose largest norm can reach that, and only pairs that do leave the join, so that few are ranked.
    Shorter vectors count as filled up with zeros, and so do null numbers; rows with a null vector find nothing and aren't found.
    """
    spark = documents.sparkSession
    some = lambda rows, key: rows.filter("vec is not null").select(key, F.col("vec").cast("array<double>").alias("vec"))
    asked, docs = materialize(some(queries, "qid"), "asked"), materialize(some(documents, "did"), "searched")
    (many, a), (n, b) = (x.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first() for x in (asked, docs))
    cells, wide, width = max(1, -(-n // ARRAY_ROWS)), min(a, b), shuffle_width(spark)
    lots = max(1, -(-many // ARRAY_ROWS), min(width // cells, -(-many // 256)))  # enough blocks for all tasks
    parts = min(cells * lots, 16 * width)
    numbers = lambda x: [F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0)).alias(f"{x}{i}") for i in range(wide)]
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))).alias("norm")
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots)).alias("lot")
    asked = materialize(asked.select("qid", "vec", norm, lot), "asked-norms")
    docs = docs.select("did", "vec", norm).repartitionByRange(cells, F.desc("norm"), "did").withColumn("cell", F.spark_partition_id())
    docs = materialize(docs.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("norm"), "did"))), "by-norm")
    ends = docs.groupBy("cell").agg(F.max("norm").alias("most"))
    score = sum((F.col(f"q{i}") * F.col(f"d{i}") for i in range(wide)), F.lit(0.0))
    few = f"cell = 0 and place <= {max(4 * k, 64)}"
    waves, lo, hi = [few, f"cell = 0 and not ({few})"], 1, WAVES
    while lo < cells:
        waves, lo, hi = [*waves, f"cell >= {lo} and cell < {hi}"], hi, WAVES * hi
    best = None
    for wave in waves:
        floors = asked.limit(0).select("qid", F.lit(None).cast("double").alias("floor")) if best is None else best.filter(F.col("rank") == k).groupBy("qid").agg(F.min("score").alias("floor"))
        # a little more than the bound, for rounding
        reach = F.col("floor").isNull() | (F.col("norm") * F.col("most") * (1 + 1e-9) + 1e-12 >= F.col("floor"))
        now = docs.filter(wave)
        sent = asked.join(floors, "qid", "left").crossJoin(F.broadcast(ends.join(now.select("cell").distinct(), "cell"))).filter(reach)
        held = now.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)).cast("array<long>"))).select("cell", "lot", "did", *numbers("d"))
        # a partition number of its own keeps small blocks from being put together in few tasks
        sent = sent.select("cell", "lot", "qid", "floor", *numbers("q")).repartition(parts, "cell", "lot")
        pairs = sent.join(held.repartition(parts, "cell", "lot").hint("shuffle_hash"), ["cell", "lot"]).withColumn("score", score).filter("floor is null or score >= floor")
        hits = pairs.select("qid", "did", "score")
        best = materialize(ranked(hits if best is None else best.drop("rank").unionByName(hits), k), "best")
    return best


def k_means(x: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty cell moves to the point farthest from its centre."""
    draw = np.random.default_rng(seed)
    centre = x[draw.choice(len(x), size=min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)
        own = far.argmin(1)
        count = np.bincount(own, minlength=len(centre))
        for j in range(len(centre)):
            centre[j] = x[own == j].mean(0) if count[j] else x[far.min(1).argmax()]
    return centre


class CellIndex:
    """Documents by cell (a written table), with the cells' centres."""

    def __init__(self, documents: DataFrame, cells: int, seed: int = 42):
        ship(documents.sparkSession)
        self.most, self.centres, table = assigned(documents, cells, seed)
        self.table = materialize(table, "cells", "cell")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        return probed(self.table, self.centres, queries, k, probes, lambda table: blockjoin.Cell(table.column("did").combine_chunks(), vectors_of(table.column("vec").combine_chunks()), k, False, None))[0]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """With one more number that gives all documents the same norm, so that inner product order is distance order."""
    return np.concatenate([x, np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0))[:, None]], 1)


def assigned(documents: DataFrame, cells: int, seed: int) -> tuple[float, np.ndarray, DataFrame]:
    """The largest norm, centres of lifted documents, and (did, vec, lot, cell): a cell's documents in lots of ``LOT_ROWS`` at most (about)."""
    spark = documents.sparkSession
    rows = materialize(documents.filter("vec is not null").select("did", F.col("vec").cast("array<double>").alias("vec"), sketch.norm(F.col("vec")).alias("norm")), "indexed")
    total, most = rows.agg(F.count("*"), F.max("norm")).first()
    if not total:
        raise ValueError("there are no documents to index")
    grain = 1 << 30
    drawn = rows.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(grain)) < max(1, int(grain * min(1.0, SAMPLE_ROWS / total))))
    x = vectors_of(drawn.select("vec").toArrow().column(0).combine_chunks())
    if not len(x):
        x = vectors_of(rows.limit(1).select("vec").toArrow().column(0).combine_chunks())
    centres = k_means(lifted(x, most), cells, seed)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                own = ((c * c).sum(1) - 2 * lifted(vectors_of(batch.column(1)), most) @ c.T).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["did", "vec", "cell"])

    table = materialize(rows.select("did", "vec").mapInArrow(assign, f"did {dict(documents.dtypes)['did']}, vec array<double>, cell int"), "assigned")
    size = {r.cell: r.n for r in table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a number a cell
    lots = F.create_map(*[F.lit(x) for c, n in size.items() for x in (c, -(-n // LOT_ROWS))])
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), lots[F.col("cell")])
    return most, centres, table.withColumn("lot", lot.cast("int")).repartition(shuffle_width(spark), "cell", "lot").select("did", "vec", "lot", "cell")


def probed(table: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, hold) -> tuple[DataFrame, DataFrame]:
    """Hits of ``queries`` in the ``probes`` cells nearest to each, and the written raw rows (qid, did, score, cell, products).

    ``table`` has did, its own columns, lot and cell; ``hold`` makes something with ``ids``, ``search`` and ``products`` of a lot's rows.
    """
    spark = table.sparkSession
    ship(spark)
    q_type, d_type = dict(queries.dtypes)["qid"], dict(table.dtypes)["did"]
    shared = spark.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                order = ((c * c).sum(1) - 2 * vectors_of(batch.column(1)) @ c[:, :-1].T).argsort(1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(batch.num_rows), order.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(order.ravel().astype(np.int32))], names=["qid", "qvec", "cell"])

    asked = queries.filter("vec is not null").select("qid", F.col("vec").cast("array<double>")).mapInArrow(near, f"qid {q_type}, qvec array<double>, cell int")
    asked = materialize(asked, "probes")
    lots = table.select("cell", "lot").distinct()  # numbers of lots: some of LOT_ROWS documents each
    lots = materialize(lots.join(asked.select("cell").distinct(), "cell"), "lots")
    number = {(r.cell, r.lot): i for i, r in enumerate(lots.collect())}
    if not number:
        return ranked(spark.createDataFrame([], f"qid {q_type}, did {d_type}, score double"), k), spark.createDataFrame([], f"qid {q_type}, did {d_type}, score double, cell long, products long")
    key = spark.createDataFrame([(c, lot, i) for (c, lot), i in number.items()], "cell int, lot int, number long")
    some = table.filter(F.col("cell").isin(sorted({c for c, _ in number}))).join(F.broadcast(key), ["cell", "lot"])
    docs = some.drop("cell", "lot").withColumnRenamed("number", "cell")
    asks = asked.join(F.broadcast(key), "cell").select(F.col("number").alias("cell"), "qid", "qvec")
    return in_lots(docs, asks, len(number), hold, k)


def in_lots(docs: DataFrame, asked: DataFrame, lots: int, hold, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits of ``asked`` (cell, qid, qvec) in ``docs`` (cell, did, ...), whose cells are numbers under ``lots``; and the written raw rows (qid, did, score, cell, products)."""
    q_type, d_type = dict(asked.dtypes)["qid"], dict(docs.dtypes)["did"]
    own = [(c, t) for c, t in docs.dtypes if c not in ("did", "cell")]
    sides = [docs.select("cell", F.lit(0).alias("kind"), "did", *(c for c, _ in own), F.lit(None).cast(q_type).alias("qid"), F.lit(None).cast("array<double>").alias("qvec"))]
    sides += [asked.select("cell", F.lit(1).alias("kind"), F.lit(None).cast(d_type).alias("did"), *(F.lit(None).cast(t).alias(c) for c, t in own), "qid", "qvec")]
    both = sides[0].unionByName(sides[1]).repartitionById(lots, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")
    q_arrow, d_arrow = blockjoin.arrow_type(q_type), blockjoin.arrow_type(d_type)
    names = ["qid", "did", "score", "cell", "products"]

    def answer(lot, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, QUERIES):
            few = part.slice(at, QUERIES)
            vectors = vectors_of(few.column(few.schema.get_field_index("qvec")))
            q, d, score = lot.search(vectors, np.full(len(vectors), -np.inf))
            if len(q):
                qid = few.column(few.schema.get_field_index("qid")).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([qid, lot.ids.take(pa.array(d)), pa.array(score), pa.array(np.full(len(q), few.column(0)[0].as_py())), pa.nulls(len(q), pa.int64())], names=names)

    def close(lot, n: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, q_arrow), pa.nulls(1, d_arrow), pa.nulls(1, pa.float64()), pa.array([n]), pa.array([lot.products])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return blockjoin.stream_cells(batches, lambda t: hold(t.combine_chunks()), answer, close)

    raw = materialize(both.mapInArrow(run, f"qid {q_type}, did {d_type}, score double, cell long, products long"), "lot-hits")
    return blockjoin.merged(raw.filter("products is null"), k, lots), raw


def overlap(approximate: DataFrame, truth: DataFrame) -> float:
    """Share of the true hits that the approximate lists have."""
    total = truth.count()
    return truth.join(approximate, ["qid", "did"], "left_semi").count() / total if total else 1.0


def construct_run(hits: DataFrame) -> DataFrame:
    """(qid, did, rank, score): score = length of the query's list - rank from 0; a hit that is the query itself is then dropped."""
    size = F.count("*").over(Window.partitionBy("qid"))
    out = hits.select("qid", "did", "rank", (size - (F.col("rank") - 1)).cast("double").alias("score"))
    return out.filter(F.col("qid").cast("string") != F.col("did").cast("string"))

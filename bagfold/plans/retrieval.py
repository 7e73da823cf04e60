"""Retrieval from bags to metrics: an offline half that builds a model and a document index, and an online half that answers queries.

Hybrid: the PCA is fitted on the standardised encodings of a sample; raw document encodings are projected and divided by the norm of
the whole raw encoding, query encodings are normalised first; both are followed by a single vector. Multi-vector only: the PCA is fitted on
all documents, which are standardised and projected in one affine map; queries are projected as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EncoderConfig, Encoding, Projection, RetrievalSettings
from ..operators import encode as enc
from ..operators import blockjoin, fusion, graph, metrics, pca, search, select
from ..runtime import exists, materialize, ship
from ..sources import tokens as tk

EPS = 1e-12


@dataclass
class Offline:
    """What the online half needs: encoder, chosen repetitions, projection, and the documents' vectors (did, vec)."""

    config: EncoderConfig
    reps: list[int]
    model: pca.BlockPCA
    documents: DataFrame
    hybrid: bool
    times: dict[str, float]
    words: Broadcast | None = None


def encoded_batches(config: EncoderConfig, reps: list[int], words: Broadcast | None) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Flat encodings of batches of bags (id, vecs), or of counted texts (id, vec_ids, times) over the dictionary ``words`` (sorted ids and vectors)."""
    if words is not None:
        return _counted_encoder(config, reps, *words.value)
    encoder = enc.Encoder(config, reps)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        return encoder.encode(*enc.bag_arrays(batch.column(1), config.dimension))[0].reshape(batch.num_rows, -1)

    return run


def _columns(bags: DataFrame, words: Broadcast | None) -> DataFrame:
    return bags.select("id", "vecs") if words is None else bags.select("id", "vec_ids", "times")


def projected_rows(model: pca.BlockPCA, x: np.ndarray, how: str) -> np.ndarray:
    """Flat encodings as the index ("document", "standardised") or a search ("query", "unit_query") takes them."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if how == "standardised":
        return model.transform_standardised(x)
    if how == "unit_query":
        return model.transform(x / np.maximum(norm, EPS))
    y = model.transform(x)
    return y / (norm + EPS) if how == "document" else y


def _projected(bags: DataFrame, config: EncoderConfig, reps: list[int], model: pca.BlockPCA, how: str, words: Broadcast | None = None) -> DataFrame:
    """(id, vec): encode and project in one pass, so that no full encoding leaves the task.

    ``how``: "document" raw projection over the norm of the raw encoding, "standardised", "query" as is, "unit_query" normalised before.
    """
    spark = bags.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoded_batches(config, reps, words), enc.rows_at_once(config, len(reps))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.float_lists(projected_rows(shared.value, encode(part), how))], names=["id", "vec"])

    return _columns(bags, words).mapInArrow(run, f"id {dict(bags.dtypes)['id']}, vec array<double>")


def _encoded(bags: DataFrame, config: EncoderConfig, reps: list[int], words: Broadcast | None) -> DataFrame:
    """(id, fde)."""
    ship(bags.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoded_batches(config, reps, words), enc.rows_at_once(config, len(reps))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.float_lists(encode(part))], names=["id", "fde"])

    return _columns(bags, words).mapInArrow(run, f"id {dict(bags.dtypes)['id']}, fde array<double>")


def offline(corpus: DataFrame, dimension: int, settings: RetrievalSettings, hybrid: bool = True, words: tuple[np.ndarray, np.ndarray] | None = None) -> Offline:
    """Choose repetitions on a sample, fit the projection and index the corpus: bags (id, vecs), or counted texts (id, vec_ids, times) over the dictionary ``words``, which is then broadcast."""
    times, began = {}, time.time()

    def lap(name: str) -> None:
        nonlocal began
        times[name], began = time.time() - began, time.time()

    shared = None if words is None else corpus.sparkSession.sparkContext.broadcast(words)
    documents = corpus.count()
    sample_size = max(1, int(documents * settings.sampling_rate))
    block = (1 << settings.bits) * settings.projection_dimension
    if (sample_size if hybrid else documents) <= block or sample_size <= block:
        raise ValueError(f"a sample of {sample_size} is too small for blocks of {block} dimensions; raise sampling_rate or lower bits or projection_dimension")
    config = EncoderConfig(dimension, settings.repetitions, settings.bits, settings.encoder_seed, Encoding.AVERAGE, Projection.AMS, settings.projection_dimension)
    sample = tk.sampled_rows(corpus, settings.sampling_rate, settings.sample_seed)
    bounds = select.distortion_bound(counts_of_bags(sample, config, shared), sample_size)
    reps = select.chosen(bounds, select.keep_count(settings.repetitions, settings.choose_rate))
    lap("choose repetitions")
    model = pca.fit(_encoded(sample if hybrid else corpus, config, reps, shared), len(reps), settings.keep_dimensions)
    lap("fit projection")
    vectors = _projected(corpus, config, reps, model, "document" if hybrid else "standardised", shared)
    index = materialize(vectors.withColumnRenamed("id", "did"), "document-vectors")
    lap("index documents")
    return Offline(config, reps, model, index, hybrid, times, shared)


def counts_of_bags(bags: DataFrame, config: EncoderConfig, words: Broadcast | None = None) -> DataFrame:
    """(id, rep, part, cnt) of all repetitions, from bag rows without a shuffle."""
    ship(bags.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = enc.Encoder(config)
        known = None if words is None else _Looked(*words.value, 8 * config.repetitions, lambda v: encoder.parts(encoder.bits(v)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if known is None:
                    points, off = enc.bag_arrays(part.column(1), config.dimension)
                    parts, times = encoder.parts(encoder.bits(points)), np.ones(len(points), np.int64)
                else:
                    off = np.concatenate([[0], np.cumsum(np.diff(np.asarray(part.column(1).offsets)))])
                    table, which = known.of(part.column(1).flatten().to_numpy())
                    parts, times = table[which], part.column(2).flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(off))
                key = (owner[:, None] * config.repetitions + np.arange(config.repetitions)) * config.buckets + parts
                key, place = np.unique(key.reshape(-1), return_inverse=True)
                count = np.bincount(place.ravel(), np.repeat(times, config.repetitions), len(key)).astype(np.int64)
                rep = key // config.buckets
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rep // config.repetitions)), pa.array((rep % config.repetitions).astype(np.int32)), pa.array((key % config.buckets).astype(np.int32)), pa.array(count)], names=["id", "rep", "part", "cnt"]
                )

    return _columns(bags, words).mapInArrow(run, f"id {dict(bags.dtypes)['id']}, rep int, part int, cnt long")


def query_vectors(built: Offline, queries: DataFrame) -> DataFrame:
    """(qid, vec) of query bags (id, vecs)."""
    vectors = _projected(queries, built.config.for_queries(), built.reps, built.model, "unit_query" if built.hybrid else "query", built.words)
    return vectors.withColumnRenamed("id", "qid")


def with_single(vectors: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """The multi-vector part followed by the single vector (id, sv), neither normalised."""
    return fusion.concat(vectors, single.withColumnRenamed("id", key), key, normalise_parts=False, normalise_all=False)


def online(built: Offline, queries: DataFrame, top_k: int, corpus_single: DataFrame | None = None, query_single: DataFrame | None = None, fused: fusion.PerDimension | None = None, cells: int | None = None, probes: int | None = None, index: str | None = None, beam: int = graph.BEAM) -> DataFrame:
    """The run (qid, did, rank, score) of query bags.

    ``index`` searches approximately along the graph that is saved there, which is built first if there is none (other documents, settings or scales need another path);
    ``cells`` does so in the ``probes`` nearest of so many cells (five in six).
    """
    q, d = query_vectors(built, queries), built.documents
    if built.hybrid:
        if corpus_single is None or query_single is None:
            raise ValueError("a hybrid plan needs single vectors of both sides")
        if fused is None:
            q, d = with_single(q, query_single, "qid"), with_single(d, corpus_single, "did")
        else:
            a, b = fused.parts()
            q = fusion.scaled_concat(q, query_single.withColumnRenamed("id", "qid"), a, b, "qid", False, False)
            d = fusion.scaled_concat(d, corpus_single.withColumnRenamed("id", "did"), a, b, "did", False, False)
    if index is not None:
        saved = graph.GraphIndex(d.sparkSession, index) if exists(d.sparkSession, index) else graph.GraphIndex.build(d, index)
        hits = saved.search(q, top_k, beam).hits
    elif cells is not None:
        hits = search.CellIndex(d, cells).search(q, top_k, probes or -(-5 * cells // 6))
    else:
        hits = search.exact(q, d, top_k)
    return search.construct_run(hits)


def fit_fusion(built: Offline, queries: DataFrame, qrels: DataFrame, corpus_single: DataFrame, query_single: DataFrame, top_k: int = 10, negatives: int = 64, epochs: int = 20, rate: float = 0.1, seed: int = 42) -> tuple[fusion.PerDimension, list[float]]:
    """Per-dimension scales from training queries: positives, mined and uniform negatives drawn anew for each epoch, gradient steps."""
    q = query_vectors(built, queries)
    found = materialize(fusion.positives(qrels, q, built.documents), "positives")
    sv_q, sv_d = query_single.withColumnRenamed("id", "qid"), corpus_single.withColumnRenamed("id", "did")
    hits = search.exact(with_single(q, query_single, "qid"), with_single(built.documents, corpus_single, "did"), fusion.hard_top_k(top_k, built.documents.count()))
    hard = materialize(fusion.hard_negatives(hits, found), "hard-negatives")
    pools = fusion.negative_pools(found, built.documents, hard)
    sides = materialize(q.join(sv_q, "qid"), "train-queries"), materialize(built.documents.join(sv_d, "did"), "train-documents")
    rows = lambda epoch: fusion.triples(found, fusion.drawn_negatives(pools, negatives, seed, epoch), *sides, normalise_parts=False)
    model = fusion.PerDimension.ones(built.model.weights.shape[1], len(corpus_single.first().sv))
    return model, fusion.train(model, rows, epochs=epochs, rate=rate, decay=1e-5, seed=seed)


def text_bags(texts: DataFrame, embeddings: DataFrame, id: str, text: str = "text") -> DataFrame:
    """Bags of a text table: each token stands for one row of ``embeddings``.

    Tokens are counted per text before the vectors come in, so a vector is shipped once for each text that has it; it is
    repeated as often as the token is, for buckets are sums and means over tokens.
    """
    n = embeddings.count()
    counted = tk.text_tokens(texts, n, id, text).groupBy("id", "vec_id").agg(F.count("*").cast("int").alias("n"))
    vectors = embeddings.select("vec_id", "embedding")
    # a word that many texts have is a hot key of a join by hash
    found = counted.join(F.broadcast(vectors) if n * 8 * len(embeddings.first().embedding) <= DICTIONARY_BYTES else vectors, "vec_id") if n else counted.join(vectors, "vec_id")
    lists = found.groupBy("id").agg(F.flatten(F.collect_list(F.array_repeat("embedding", F.col("n")))).alias("vecs"))
    return texts.select(F.col(id).alias("id")).join(lists, "id", "left").withColumn("vecs", F.coalesce("vecs", F.expr("cast(array() as array<array<float>>)")))


#: Largest dictionary of 32-bit vectors that is broadcast, and bytes of what is worked out for all of them at once; of a larger one only for those that a batch has.
DICTIONARY_BYTES, LOOKED_BYTES = 512 << 20, 64 << 20


def dictionary(embeddings: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted ids and 32-bit vectors, or None if they are too many to broadcast."""
    if embeddings.count() * (8 + 4 * dimension) > DICTIONARY_BYTES:
        return None
    table = embeddings.select("vec_id", F.col("embedding").cast("array<float>")).orderBy("vec_id").toArrow()
    flat = table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column(0).to_numpy(), flat.reshape(table.num_rows, -1)


class _Looked:
    """What ``work`` makes of dictionary vectors: of all of them once if that stays under ``LOOKED_BYTES``, else of those of each batch."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, row_bytes: int, work: Callable[[np.ndarray], object]):
        self.ids, self.vectors, self.work = ids, vectors, work
        self.all = work(vectors) if len(ids) * row_bytes <= LOOKED_BYTES else None

    def of(self, vec_ids: np.ndarray) -> tuple[object, np.ndarray]:
        """The work, and the place in it of each of ``vec_ids``."""
        which = np.searchsorted(self.ids, vec_ids)
        if self.all is not None:
            return self.all, which
        some, which = np.unique(which, return_inverse=True)
        return self.work(self.vectors[some]), which


def counted_texts(texts: DataFrame, vectors: int, id: str, text: str = "text", empty: bool = False) -> DataFrame:
    """(id, vec_ids, times): which vectors a text has, and how often; texts without any only if ``empty``.

    A text is counted where it lies. Only rows that share their id with others, or have none, are shuffled, as their texts count together.
    """
    ship(texts.sparkSession)
    if not vectors:
        return _counted_together(texts, vectors, id, text, empty)
    own, again = tk.by_repetition(texts, id)
    out = tk.text_vector_ids(own, vectors, id, text).mapInArrow(_counts, f"id {dict(texts.dtypes)[id]}, vec_ids array<bigint>, times array<bigint>")
    if not empty:
        out = out.filter(F.size("vec_ids") > 0)
    return out if again is None else out.unionByName(_counted_together(again, vectors, id, text, empty))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vec_ids) with each vector once, and ``times``."""
    for batch in batches:
        size = np.diff(np.asarray(batch.column(1).offsets))
        owner, ids = np.repeat(np.arange(batch.num_rows), size), batch.column(1).flatten().to_numpy()
        order = np.lexsort((ids, owner))
        owner, ids = owner[order], ids[order]
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(ids, prepend=-1) != 0))
        off = pa.array(np.append(0, np.cumsum(np.bincount(owner[first], minlength=batch.num_rows))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int64))) for x in (ids[first], np.diff(first, append=len(ids)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "vec_ids", "times"])


def _counted_together(texts: DataFrame, vectors: int, id: str, text: str, empty: bool) -> DataFrame:
    counted = tk.text_tokens(texts, vectors, id, text).groupBy("id", "vec_id").agg(F.count("*").alias("n"))
    out = counted.groupBy("id").agg(F.collect_list("vec_id").alias("vec_ids"), F.collect_list("n").alias("times"))
    if not empty:
        return out
    none = F.expr("cast(array() as array<bigint>)")
    return texts.select(F.col(id).alias("id")).join(out, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("vec_ids", "times")})


def counted_means(texts: DataFrame, words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, sv): the mean vector of each counted text; empty ones have the zero vector."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                off = np.concatenate([[0], np.cumsum(np.diff(np.asarray(part.column(1).offsets)))])
                times = part.column(2).flatten().to_numpy()
                total = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors[np.searchsorted(ids, part.column(1).flatten().to_numpy())].astype(float) * times[:, None], 0)])
                many = np.append(0, np.cumsum(times))
                mean = (total[off[1:]] - total[off[:-1]]) / np.maximum(many[off[1:]] - many[off[:-1]], 1)[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), enc.float_lists(mean)], names=["id", "sv"])

    return texts.select("id", "vec_ids", "times").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, sv array<double>")


def _counted_encoder(config: EncoderConfig, reps: list[int], ids: np.ndarray, vectors: np.ndarray):
    encoder = enc.Encoder(config, reps)
    known = _Looked(ids, vectors, 8 * len(encoder.reps) * (config.width + 1), encoder.looked_up)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        off = np.concatenate([[0], np.cumsum(np.diff(np.asarray(batch.column(1).offsets)))])
        look, which = known.of(batch.column(1).flatten().to_numpy())
        return encoder.encode_counted(look, which, batch.column(2).flatten().to_numpy(), off).reshape(batch.num_rows, -1)

    return run


def encoded_search(documents: DataFrame, queries: DataFrame, words: tuple[np.ndarray, np.ndarray], config: EncoderConfig, k: int, reps: list[int] | None = None) -> DataFrame:
    """The best k documents for each query, both as counted texts over one dictionary.

    A document is encoded once, in the task that scores it, and leaves nothing but hits; the queries' counts are sent to the documents' cells and encoded there.
    """
    spark = documents.sparkSession
    ship(spark)
    reps = config.chosen(reps)
    shared = spark.sparkContext.broadcast(words)
    q_config, d_config = config.for_queries(), config.for_documents(fill=False)
    step = enc.rows_at_once(config, len(reps))

    def encoded(config: EncoderConfig) -> Callable[[pa.RecordBatch], np.ndarray]:
        made: list[Callable[[pa.RecordBatch], np.ndarray]] = []

        def run(batch: pa.RecordBatch) -> np.ndarray:
            if not made:  # once a task
                made.append(_counted_encoder(config, reps, *shared.value))
            named = batch.add_column(0, "id", pa.nulls(batch.num_rows))
            return np.concatenate([made[0](named.slice(at, step)) for at in range(0, batch.num_rows, step)])

        return run

    # rounded, so that copies of a document tie and rank by id
    sides = [x.select(F.col("id").alias(name), "vec_ids", "times") for x, name in ((queries, "qid"), (documents, "did"))]
    return blockjoin.block_join(*sides, k, 8 * len(reps) * config.block, encoded(d_config), ROUNDED, encoded(q_config))


#: Places of scores by which copies of a document tie.
ROUNDED = 9


def bag_means(bags: DataFrame, size: int) -> DataFrame:
    """(id, sv): the mean vector of each bag (id, vecs); empty bags have the zero vector."""
    ship(bags.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, off = enc.bag_arrays(batch.column(1), size)
            total = np.concatenate([np.zeros((1, size)), np.cumsum(points.astype(float), 0)])
            mean = (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), enc.float_lists(mean)], names=["id", "sv"])

    return bags.select("id", "vecs").mapInArrow(run, f"id {dict(bags.dtypes)['id']}, sv array<double>")


def single_vectors(texts: DataFrame, embeddings: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, sv): the mean of a text's vectors; texts without tokens have the zero vector."""
    words = dictionary(embeddings, len(embeddings.first().embedding))
    if words is not None:
        return counted_means(counted_texts(texts, len(words[0]), id, text, empty=True), words)
    return bag_means(text_bags(texts, embeddings, id, text), len(embeddings.first().embedding))


#: Runs of words (two numbers each) that are broadcast at most.
ITEM_RUNS = 1_000_000


def shared_passages(documents: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """Judgements (qid, did, rel = 1): documents that share a run of ``words`` words with an item."""

    def runs(rows: DataFrame, key: str, name: str) -> DataFrame:
        own = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \n\t\r]+"), lambda x: x != "")
        rows = rows.select(F.col(key).alias(name), own.alias("w")).filter(F.size("w") >= words)
        starts = F.sequence(F.lit(1), F.size("w") - words + 1)
        return rows.select(name, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, F.lit(words)))))).alias("h"))

    left, right = materialize(runs(items, "item_id", "qid"), "item-runs"), runs(documents, "doc_id", "did")
    if left.count() <= ITEM_RUNS:  # then no run of a document is shuffled, be it ever so common
        left = F.broadcast(left)
    return left.join(right, "h").select("qid", "did").distinct().withColumn("rel", F.lit(1))

"""Queries over the test tables, one for each operator, with the same in DuckDB SQL where SQL can say it.

Two sets of bags. E: every row of ``embeddings`` is one vector; row ``v`` belongs to group ``v % n`` (n a fifth of the rows) and is a document's vector if its
turn ``v div n`` is at most ``group % 5``, else a query's. T: the words of ``documents`` and ``benchmark``, each hashed to a row of ``embeddings``.
Numbers are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EncoderConfig, Encoding, Projection, RetrievalSettings
from .functions import randmat, sketch
from .operators import encode as enc
from .operators import fusion, graph, metrics, pca, search, select, stats
from .plans import retrieval
from .runtime import delete_at_end, materialize, scratch_path, shuffle_width
from .sources import tokens as tk

Query = Callable[[SparkSession, str], DataFrame]

E = EncoderConfig(64, 4, 3, 42, Encoding.AVERAGE, Projection.AMS, 4)
KEEP = [2, 0]
FINAL = EncoderConfig(64, 4, 3, 42, Encoding.SUM, Projection.AMS, 4, final_dimension=16)
SCALES = (1.25, 0.75)
PROJECT_DIM = 8
KS = [1, 5, 10]
T_SETTINGS = RetrievalSettings(choose_rate=0.8, repetitions=20, bits=3, projection_dimension=8, keep_dimensions=200, sampling_rate=0.5, top_k=10)


def six(column) -> F.Column:  # type: ignore[name-defined]
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + 0.0


def longs(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


# ---- set E


def tokens_e(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Token tables of documents and queries."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    n = rows.count() // 5
    rows = rows.select((F.col("vec_id") % n).alias("g"), F.floor(F.col("vec_id") / n).cast("long").alias("t"), F.col("embedding").alias("vec"))
    own = F.col("t") <= F.col("g") % 5
    return rows.filter(own).select(F.col("g").alias("id"), F.col("t").alias("pos"), "vec"), rows.filter(~own).select(F.col("g").alias("id"), (F.col("t") - F.col("g") % 5 - 1).alias("pos"), "vec")


def docs_e(spark: SparkSession, d: str) -> DataFrame:
    return tokens_e(spark, d)[0]


def bags_e(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, queries = tokens_e(spark, d)
    return tk.pack(docs), tk.pack(queries)


def projector() -> np.ndarray:
    """A fixed matrix with orthonormal columns: it checks projections, not their fit."""
    return np.linalg.qr(np.random.default_rng(7).normal(size=(E.dimension, PROJECT_DIM)))[0]


def means_e(rows: DataFrame) -> DataFrame:
    """(id, vec): the mean vector of every bag, number by number.

    Bags are collected whole, and averaged where they lie: a row for each number of each bag would fill the task that reads them.
    """
    bags = rows.groupBy("id").agg(F.collect_list("vec").alias("bag"))
    size = F.array_max(F.transform("bag", F.size))

    def mean(i: Column) -> Column:
        numbers = F.filter(F.transform("bag", lambda v: F.get(v, i).cast("double")), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x), F.size(numbers))

    return bags.filter(size > 0).select("id", F.transform(F.sequence(F.lit(0), size - 1), mean).alias("vec"))


SQL_E = """
n AS (SELECT count(*) // 5 AS n FROM embeddings),
tok AS (SELECT vec_id % n AS g, vec_id // n AS t, embedding AS vec FROM embeddings, n),
ct AS (SELECT g AS id, t AS pos, vec FROM tok WHERE t <= g % 5),
qt AS (SELECT g AS id, t - g % 5 - 1 AS pos, vec FROM tok WHERE t > g % 5),
cx AS (SELECT id, pos, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS i FROM ct),
qx AS (SELECT id, pos, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS i FROM qt),
cm AS (SELECT id, i, avg(x) AS x FROM cx GROUP BY id, i),
qm AS (SELECT id, i, avg(x) AS x FROM qx GROUP BY id, i)"""


def sql_sketch(config: EncoderConfig = E) -> str:
    k = config.bits
    return f"""{SQL_E},
planes(rep, bit, v) AS (VALUES {randmat.planes_sql(config)}),
tg(rep, i, target, sign) AS (VALUES {randmat.targets_sql(config)}),
cs AS (SELECT id, pos, rep, sum(CASE WHEN list_inner_product(vec::DOUBLE[], v) > 0 THEN 1 << ({k} - 1 - bit) ELSE 0 END)::BIGINT AS value,
         sum(CASE WHEN list_inner_product(vec::DOUBLE[], v) > 0 THEN 1 << bit ELSE 0 END)::BIGINT AS low FROM ct, planes GROUP BY id, pos, rep),
qs AS (SELECT id, pos, rep, sum(CASE WHEN list_inner_product(vec::DOUBLE[], v) > 0 THEN 1 << ({k} - 1 - bit) ELSE 0 END)::BIGINT AS value FROM qt, planes GROUP BY id, pos, rep),
cp AS (SELECT id, pos, rep, value, low, xor(xor(value, value >> 1), value >> 2) AS part FROM cs),
qp AS (SELECT id, pos, rep, value, xor(xor(value, value >> 1), value >> 2) AS part FROM qs),
cc AS (SELECT id, rep, part, count(*) AS cnt FROM cp GROUP BY ALL),
csum AS (SELECT p.id, p.rep, p.part, tg.target AS i, sum(x * sign) AS value FROM cp p JOIN cx ON p.id = cx.id AND p.pos = cx.pos JOIN tg ON tg.rep = p.rep AND tg.i = cx.i GROUP BY ALL),
cavg AS (SELECT id, rep, part, i, value / cnt AS value FROM csum JOIN cc USING (id, rep, part)),
qsum AS (SELECT p.id, p.rep, p.part, tg.target AS i, sum(x * sign) AS value FROM qp p JOIN qx ON p.id = qx.id AND p.pos = qx.pos JOIN tg ON tg.rep = p.rep AND tg.i = qx.i GROUP BY ALL),
bound AS (SELECT rep, 2.0 - 2.0 * min(mean) AS bound FROM (SELECT rep, part, (n.n - count(*) + sum(1.0 / cnt)) / n.n AS mean FROM cc, n GROUP BY rep, part, n.n) GROUP BY rep)"""


R6 = "round({}, 6) + 0.0"


def mv_pack_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tk.lengths(bags_e(spark, d)[0])


def mv_gather_subset(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_e(spark, d)
    own = docs.select("id").distinct()
    n = own.count()
    ids = own.select((37 * F.col("id") % n).alias("ord"), "id").unionByName(own.filter("id % 3 = 0").select((F.lit(n) + F.col("id")).alias("ord"), "id"))  # every id, some twice
    out = tk.gather(docs, ids)
    return out.groupBy("ord", "id").agg(F.count("*").alias("vectors"), six(F.sum(F.element_at("vec", 1).cast("double"))).alias("first_sum"))


def simhash_part_index(spark: SparkSession, d: str) -> DataFrame:
    return longs(enc.sketched(docs_e(spark, d), E).select("id", "pos", "rep", "value", "part"), "rep", "value", "part")


def gray_label_alt(spark: SparkSession, d: str) -> DataFrame:
    return longs(enc.sketched(docs_e(spark, d), E).select("id", "pos", "rep", "label"), "rep", "label")


def hamming_to_part(spark: SparkSession, d: str) -> DataFrame:
    rows = enc.sketched(docs_e(spark, d), E).select("id", "pos", "rep", "value").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(E.buckets - 1))))
    far = sketch.bucket_distance(F.col("value"), F.col("part"), E.bits)
    true = sketch.bucket_distance(F.col("value"), F.col("part"), E.bits, inverse=True)
    return longs(rows.select("id", "pos", "rep", "part", far.alias("distance"), true.alias("inverse_distance")), "rep", "part", "distance", "inverse_distance")


def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return longs(enc.partition_counts(docs_e(spark, d), E), "rep", "part", "cnt")


def partition_counts_bags(spark: SparkSession, d: str) -> DataFrame:
    return longs(retrieval.counts_of_bags(bags_e(spark, d)[0], E), "rep", "part", "cnt")


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_e(spark, d)
    return select.distortion_bound(enc.partition_counts(docs, E), docs.select("id").distinct().count())


def distortion_bound(spark: SparkSession, d: str) -> DataFrame:
    return longs(_bounds(spark, d).select("rep", six("bound").alias("bound")), "rep")


def rep_ranking(spark: SparkSession, d: str) -> DataFrame:
    return longs(select.ranked(_bounds(spark, d), 3).select("rep", "rep_pos"), "rep", "rep_pos")


def _long(rows: DataFrame) -> DataFrame:
    return longs(rows.select("id", "rep", "part", "i", six("value").alias("value")), "rep", "part", "i").filter("value <> 0")


def fde_query_sum(spark: SparkSession, d: str) -> DataFrame:
    return _long(enc.to_long(enc.encode(bags_e(spark, d)[1], E, kind="query"), E))


def fde_doc_avg(spark: SparkSession, d: str) -> DataFrame:
    return _long(enc.to_long(enc.encode(bags_e(spark, d)[0], E, kind="document"), E))


def fde_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _long(enc.encode_tokens(docs_e(spark, d), E, kind="document"))


def fde_identity(spark: SparkSession, d: str) -> DataFrame:
    plain = EncoderConfig(64, 2, 3, 42)
    return _long(enc.to_long(enc.encode(bags_e(spark, d)[1], plain), plain))


def fde_fill_empty(spark: SparkSession, d: str) -> DataFrame:
    config = E.for_documents(fill=True)
    return _long(enc.to_long(enc.encode(bags_e(spark, d)[0], config), config))


def fde_fill_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _long(enc.encode_tokens(docs_e(spark, d), E.for_documents(fill=True)))


def fde_rep_select(spark: SparkSession, d: str) -> DataFrame:
    return _long(enc.to_long(enc.encode(bags_e(spark, d)[0], E, KEEP, kind="document"), E, KEEP))


def fde_query_rep_select(spark: SparkSession, d: str) -> DataFrame:
    return _long(enc.to_long(enc.encode(bags_e(spark, d)[1], E, KEEP, kind="query"), E, KEEP))


def _flat(rows: DataFrame, column: str) -> DataFrame:
    return longs(rows.select("id", F.posexplode(column).alias("i", "value")).select("id", "i", six("value").alias("value")), "i").filter("value <> 0")


def final_count_sketch(spark: SparkSession, d: str) -> DataFrame:
    return _flat(enc.encode(bags_e(spark, d)[1], FINAL), "fde")


def final_count_sketch_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = enc.count_sketched(enc.encode_tokens(tokens_e(spark, d)[1], FINAL), FINAL)
    return longs(rows.select("id", "i", six("value").alias("value")), "i").filter("value <> 0")


def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _flat(stats.l2_normalise(means_e(docs_e(spark, d))), "vec")


def standardise(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_e(spark, d)
    rows = stats.standardised(enc.encode_tokens(docs, E, [0, 1], kind="document"), docs.select("id").distinct())
    return longs(rows.select("id", "rep", "part", "i", six("value").alias("value")), "rep", "part", "i")


def adaptive_scales(spark: SparkSession, d: str) -> DataFrame:
    """Queries fused by weights of their own (the untrained seeded model)."""
    docs, queries = tokens_e(spark, d)
    both = [means_e(t).join(t.filter("pos = 0").select("id", F.col("vec").alias("sv")), "id") for t in (queries, docs)]
    fused, _ = fusion.apply_adaptive(both[0].withColumnRenamed("id", "qid"), both[1].withColumnRenamed("id", "did"), fusion.QueryAdaptive.seeded())
    return _flat(fused.withColumnRenamed("qid", "id"), "vec")


def sampled_items(spark: SparkSession, d: str) -> DataFrame:
    """A third of the bags, with their lengths."""
    docs = tk.pack(docs_e(spark, d))
    return tk.lengths(docs.join(tk.sample_ids(docs, 1 / 3, 42), "id", "left_semi"))


def _parts_e(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = docs_e(spark, d)
    return means_e(docs), docs.filter("pos = 0").select("id", F.col("vec").alias("sv"))


def concat_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _flat(fusion.concat(*_parts_e(spark, d)), "vec")


def apply_scales(spark: SparkSession, d: str) -> DataFrame:
    return _flat(fusion.scaled_concat(*_parts_e(spark, d), *SCALES), "vec")


def dimension_scales(spark: SparkSession, d: str) -> DataFrame:
    a, b = _parts_e(spark, d)
    own = [[0.5 + (i % 7) / 7 for i in range(64)], [1.5 - (i % 5) / 5 for i in range(64)]]
    return _flat(fusion.scaled_concat(a, b, *own, normalise_parts=False, normalise_all=False), "vec")


def _encoded_e(spark: SparkSession, d: str) -> DataFrame:
    return enc.encode(bags_e(spark, d)[0], E, kind="document")


def block_gram(spark: SparkSession, d: str) -> DataFrame:
    rows = pca.block_grams(_encoded_e(spark, d), E.repetitions)
    return longs(rows.select("block", "n", F.posexplode("s").alias("place", "value")).select("block", "n", "place", six("value").alias("value")), "block", "place").filter("value <> 0")


def block_cov_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = pca.eigenpairs(_encoded_e(spark, d), E.repetitions, standardise=False)
    return longs(rows.groupBy("block").agg(six(F.sum("eigenvalue")).alias("trace"), F.count("*").alias("dimensions")), "block")


def pca_top_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    model = pca.fit(_encoded_e(spark, d), E.repetitions, keep=20)
    return spark.createDataFrame([(j, b, i, round(float(v), 6)) for j, ((b, i), v) in enumerate(zip(model.origin, model.eigenvalues, strict=True))], "out_pos long, block long, local long, eigenvalue double")


def _model_e() -> pca.BlockPCA:
    w = projector()
    return pca.BlockPCA(w, np.ones(PROJECT_DIM), [(0, i) for i in range(PROJECT_DIM)], np.zeros(64), np.ones(64), 1)


def pca_transform(spark: SparkSession, d: str) -> DataFrame:
    return _flat(pca.transform(means_e(docs_e(spark, d)), _model_e(), "vec"), "vec")


def _means(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, queries = tokens_e(spark, d)
    return means_e(queries).withColumnRenamed("id", "qid"), means_e(docs).withColumnRenamed("id", "did")


def pca_inner_products(spark: SparkSession, d: str) -> DataFrame:
    q, x = _means(spark, d)
    q = pca.transform(q.withColumnRenamed("qid", "id"), _model_e(), "vec").withColumnRenamed("id", "qid")
    x = pca.transform(x.withColumnRenamed("did", "id"), _model_e(), "vec").withColumnRenamed("id", "did")
    return _hits(search.exact(q, x, 5))


def _hits(rows: DataFrame) -> DataFrame:
    return longs(rows.select("qid", "did", "rank", six("score").alias("score")), "rank")


def mips_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.exact(*_means(spark, d), 10))


def mips_topk_columns(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.exact_sql(*_means(spark, d), 10))


def mips_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.exact_pruned(*_means(spark, d), 10).hits)


def run_construct(spark: SparkSession, d: str) -> DataFrame:
    return _hits(search.construct_run(search.exact(*_means(spark, d), 10)))


#: Rows of documents' ids that are broadcast at most (8 bytes each).
GRID_IDS = 8 << 20


def _judged_e(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A run, and judgements made by rule: graded, some 0, some queries without any."""
    return search.construct_run(search.exact(*_means(spark, d), 12)), _qrels_e(spark, d)


def _qrels_e(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of each pair at most once, in the partition of their query: ids are laid beside each other, pairs are never shuffled."""
    docs, queries = tokens_e(spark, d)
    # few ids make many pairs: as many partitions as these need, and another number than the aggregation's, lest Spark keeps and joins those
    asked = queries.select(F.col("id").alias("qid")).distinct().repartition(2 * max(shuffle_width(spark), spark.sparkContext.defaultParallelism), "qid")
    known = docs.select(F.col("id").alias("did")).distinct()
    grid = asked.crossJoin(F.broadcast(known) if docs.count() <= GRID_IDS else known)
    return grid.filter("(qid * 7 + did * 13) % 11 < 3 and qid % 10 <> 3").select("qid", "did", ((F.col("qid") + F.col("did")) % 3).cast("int").alias("rel"))


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return longs(metrics.evaluate(*_judged_e(spark, d), KS), "k").select("metric", "k", six("value").alias("value"))


def _metric(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return longs(metrics.evaluate_one(*_judged_e(spark, d), KS, name), "k").select("metric", "k", six("value").alias("value"))

    return query


def positive_lists(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = tokens_e(spark, d)
    return fusion.positives(_qrels_e(spark, d), queries.select(F.col("id").alias("qid")).distinct(), docs.select(F.col("id").alias("did")).distinct(), distinct=False)


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    q, x = _means(spark, d)
    hits = search.exact(q, x, 20)
    return longs(fusion.hard_negatives(hits, positive_lists(spark, d)), "rank")


#: Of 12 cells; the tables' vectors hardly cluster, so that 8 find 0.81 of the true hits.
IVF_PROBES = 10


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    q, x = _means(spark, d)
    return _hits(search.CellIndex(x, 12).search(q, 10, IVF_PROBES))


def _train(model, spark: SparkSession, d: str, epochs: int = 5) -> DataFrame:
    found = positive_lists(spark, d)
    docs, queries = tokens_e(spark, d)
    q = means_e(queries).join(queries.filter("pos = 0").select("id", F.col("vec").alias("sv")), "id").withColumnRenamed("id", "qid")
    x = means_e(docs).join(docs.filter("pos = 0").select("id", F.col("vec").alias("sv")), "id").withColumnRenamed("id", "did")
    losses = fusion.train(model, fusion.pooled(found, q, x, 8, 42, normalise_parts=True), epochs=epochs, batches=2, rate=0.05)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "epoch long, loss double")


def fusion_train_two_scales(spark: SparkSession, d: str) -> DataFrame:
    return _train(fusion.TwoScales(), spark, d)


def fusion_train_per_dimension(spark: SparkSession, d: str) -> DataFrame:
    return _train(fusion.PerDimension.ones(64, 64), spark, d)


def fusion_train_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return _train(fusion.QueryAdaptive.seeded(), spark, d)


# ---- set T


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text"), spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def mv_tokenise(spark: SparkSession, d: str) -> DataFrame:
    docs, _, vectors = _texts(spark, d)
    n = vectors.count()
    if not n:
        return _tokenised_together(docs, n)
    own, again = tk.by_repetition(docs.filter(F.col("text").rlike("[^ \n\t\r]")), "doc_id")
    weighted = F.transform("vec_ids", lambda v, i: v * (i % 97 + 1))
    out = tk.text_vector_ids(own, n).select(
        F.col("id").alias("doc_id"), F.size("vec_ids").cast("long").alias("tokens"), F.size(F.array_distinct("vec_ids")).cast("long").alias("vectors"), F.aggregate(weighted, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum")
    )
    return out if again is None else out.unionByName(_tokenised_together(again, n))


def _tokenised_together(docs: DataFrame, n: int) -> DataFrame:
    """Rows that share an id count as one text."""
    return tk.text_tokens(docs, n).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("tokens"), F.count_distinct("vec_id").alias("vectors"), F.sum(F.col("vec_id") * (F.col("pos") % 97 + 1)).alias("checksum"))


def graph_topk(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose mean vectors answer each passage's best, along a graph index."""
    docs, items, vectors = _texts(spark, d)
    x = retrieval.single_vectors(docs, vectors, "doc_id").select(F.col("id").alias("did"), F.col("sv").alias("vec"))
    q = retrieval.single_vectors(items, vectors, "item_id").select(F.col("id").alias("qid"), F.col("sv").alias("vec"))
    index = graph.GraphIndex.build(x, scratch_path(spark, "graph"))
    delete_at_end(spark, index.path)
    return _hits(index.search(q, 10).hits)


def shared_passages(spark: SparkSession, d: str) -> DataFrame:
    docs, items, _ = _texts(spark, d)
    return longs(retrieval.shared_passages(docs, items), "rel")


def _retrieve(spark: SparkSession, d: str, hybrid: bool) -> DataFrame:
    docs, items, vectors = _texts(spark, d)
    settings = T_SETTINGS
    words, n = retrieval.dictionary(vectors, 64), vectors.count()
    if words is not None:
        corpus = materialize(retrieval.counted_texts(docs, n, "doc_id", empty=True), "corpus-counts")
        queries = materialize(retrieval.counted_texts(items, n, "item_id", empty=True), "query-counts")
        means = lambda x: retrieval.counted_means(x, words)
    else:
        corpus = materialize(retrieval.text_bags(docs, vectors, "doc_id"), "corpus-bags")
        queries = materialize(retrieval.text_bags(items, vectors, "item_id"), "query-bags")
        means = lambda x: retrieval.bag_means(x, 64)
    built = retrieval.offline(corpus, 64, settings, hybrid, words)
    run = retrieval.online(built, queries, settings.top_k, means(corpus), means(queries)) if hybrid else retrieval.online(built, queries, settings.top_k)
    return longs(run.select("qid", "did", "rank", "score"), "rank")


def pipeline_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _retrieve(spark, d, True)


def pipeline_mv_only(spark: SparkSession, d: str) -> DataFrame:
    return _retrieve(spark, d, False)


FLAGSHIP = EncoderConfig(64, 16, 5, 42, Encoding.AVERAGE, Projection.AMS, 16)


def flagship_run(spark: SparkSession, d: str) -> DataFrame:
    """Best ten documents of each benchmark passage by the inner product of their encodings."""
    docs, items, vectors = _texts(spark, d)
    words = retrieval.dictionary(vectors, 64)
    n = vectors.count()
    if words is not None:
        hits = retrieval.encoded_search(retrieval.counted_texts(docs, n, "doc_id"), retrieval.counted_texts(items, n, "item_id"), words, FLAGSHIP, 10)
    else:
        q = enc.encode(retrieval.text_bags(items, vectors, "item_id"), FLAGSHIP, kind="query").select(F.col("id").alias("qid"), F.col("fde").alias("vec"))
        x = enc.encode(retrieval.text_bags(docs, vectors, "doc_id"), FLAGSHIP, kind="document").select(F.col("id").alias("did"), F.col("fde").alias("vec"))
        hits = search.exact(q, x, 10, retrieval.ROUNDED)
    return longs(hits.select("qid", "did", "rank"), "rank")


def flagship_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Recall and the other metrics of multi-vector retrieval of documents for benchmark passages."""
    docs, items, _ = _texts(spark, d)
    hits = flagship_run(spark, d).withColumn("score", 11.0 - F.col("rank"))
    found = materialize(retrieval.shared_passages(docs, items), "passages")  # read several times; the texts are hashed once
    return longs(metrics.evaluate(hits, found, [10], ignore_identical=False), "k")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        mv_tokenise, mv_pack_lengths, mv_gather_subset, simhash_part_index, gray_label_alt, hamming_to_part, partition_counts, partition_counts_bags, distortion_bound, rep_ranking,
        fde_query_sum, fde_doc_avg, fde_tokens, fde_identity, fde_fill_empty, fde_fill_tokens, fde_rep_select, fde_query_rep_select, adaptive_scales, sampled_items, final_count_sketch, final_count_sketch_tokens, l2_normalise, standardise,
        concat_fuse, apply_scales, dimension_scales, block_gram, block_cov_trace, pca_top_eigenvalues, pca_transform, pca_inner_products, mips_topk, mips_topk_columns, mips_pruned, run_construct,
        ranking_metrics, positive_lists, hard_negatives, ivf_search, fusion_train_two_scales, fusion_train_per_dimension, fusion_train_adaptive, shared_passages, graph_topk, pipeline_hybrid, pipeline_mv_only, flagship_run, flagship_retrieval,
    )
}
QUERIES |= {f"metric_{m}": _metric(m) for m in metrics.ALIASES}


# ---- SQL


def _select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _sql_long(table: str, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT id, rep::BIGINT AS rep, part::BIGINT AS part, i::BIGINT AS i, {R6.format('value')} AS value FROM {table} WHERE {where}) WHERE value <> 0"


_FILL = """,
every AS (SELECT unnest(range(0, 8)) AS part),
emp AS (SELECT b.id, b.rep, every.part FROM (SELECT DISTINCT id, rep FROM cp) b, every WHERE NOT EXISTS (SELECT 1 FROM cc WHERE cc.id = b.id AND cc.rep = b.rep AND cc.part = every.part)),
near AS (SELECT emp.id, emp.rep, emp.part, cp.pos, row_number() OVER (PARTITION BY emp.id, emp.rep, emp.part ORDER BY bit_count(xor(cp.value, xor(xor(emp.part, emp.part >> 1), emp.part >> 2))), cp.pos) AS n FROM emp JOIN cp ON cp.id = emp.id AND cp.rep = emp.rep),
fsum AS (SELECT near.id, near.rep, near.part, tg.target AS i, sum(x * sign) AS value FROM near JOIN cx ON cx.id = near.id AND cx.pos = near.pos JOIN tg ON tg.rep = near.rep AND tg.i = cx.i WHERE near.n = 1 GROUP BY ALL),
filled AS (SELECT id, rep, part, i, value FROM cavg UNION ALL SELECT * FROM fsum)"""


def _sql_final() -> str:
    target, sign = randmat.signed_targets(FINAL.repetitions * FINAL.block, FINAL.final_dimension, FINAL.seed)  # type: ignore[arg-type]
    rows = ", ".join(f"({j}, {int(t)}, {float(s)})" for j, (t, s) in enumerate(zip(target, sign, strict=True)))
    return _select(sql_sketch() + f",\nmv(slot, target, sign) AS (VALUES {rows})", f"SELECT * FROM (SELECT id, target::BIGINT AS i, {R6.format('sum(value * sign)')} AS value FROM qsum JOIN mv ON mv.slot = (rep * {FINAL.buckets} + part) * {FINAL.width} + i GROUP BY id, target) WHERE value <> 0")


def _sql_concat(a: str, b: str, normal: bool = True, scale_a: str = "1.0", scale_b: str = "1.0") -> str:
    parts = f"""{SQL_E},
pa AS (SELECT id, i, x{' / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12)' if normal else ''} AS x FROM {a}),
pb AS (SELECT id, i + 64 AS i, x{' / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12)' if normal else ''} AS x FROM {b}),
u AS (SELECT id, i, x * {scale_a} AS x FROM pa UNION ALL SELECT id, i, x * {scale_b} AS x FROM pb),
v AS (SELECT id, i, x{' / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12)' if normal else ''} AS x FROM u)"""
    return _select(parts, f"SELECT * FROM (SELECT id, i::BIGINT AS i, {R6.format('x')} AS value FROM v) WHERE value <> 0")


_DENSE = """,
grid AS (SELECT d.id, r.rep, p.part, j.i FROM (SELECT DISTINCT id FROM ct) d, (SELECT unnest(range(0, 4)) AS rep) r, (SELECT unnest(range(0, 8)) AS part) p, (SELECT unnest(range(0, 4)) AS i) j),
dense AS (SELECT g.id, g.rep, g.part * 4 + g.i AS slot, coalesce(value, 0.0) AS x FROM grid g LEFT JOIN cavg c ON c.id = g.id AND c.rep = g.rep AND c.part = g.part AND c.i = g.i)"""


def _sql_project() -> str:
    w = projector()
    rows = ", ".join(f"({i}, {j}, {float(w[i, j])!r})" for i in range(64) for j in range(PROJECT_DIM))
    return f"""{SQL_E},
w(i, j, y) AS (VALUES {rows}),
pd AS (SELECT id, j, sum(x * y) AS x FROM cm JOIN w USING (i) GROUP BY id, j),
pq AS (SELECT id, j, sum(x * y) AS x FROM qm JOIN w USING (i) GROUP BY id, j)"""


def _sql_topk(q: str, d: str, key: str, k: int) -> str:
    return f"""sc AS (SELECT q.id AS qid, d.id AS did, sum(q.x * d.x) AS score FROM {q} q JOIN {d} d USING ({key}) GROUP BY q.id, d.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM sc),
hits AS (SELECT * FROM rk WHERE rank <= {k})"""


_HITS = f"SELECT qid, did, rank::BIGINT AS rank, {R6.format('score')} AS score FROM hits"

_JUDGED = f"""{SQL_E},
{_sql_topk('qm', 'cm', 'i', 12)},
built AS (SELECT qid, did, rank, (count(*) OVER (PARTITION BY qid) - (rank - 1))::DOUBLE AS score FROM hits),
run AS (SELECT * FROM built WHERE qid <> did),
qrels AS (SELECT q.id AS qid, d.id AS did, ((q.id + d.id) % 3)::INT AS rel FROM (SELECT DISTINCT id FROM qt) q, (SELECT DISTINCT id FROM ct) d WHERE (q.id * 7 + d.id * 13) % 11 < 3 AND q.id % 10 <> 3)"""

_METRICS = f"""{_JUDGED},
ks AS (SELECT unnest({KS}) AS k),
hit AS (SELECT run.qid, run.did, row_number() OVER (PARTITION BY run.qid ORDER BY run.score DESC, run.did) AS place, coalesce(r.rel, 0) AS rel FROM run LEFT JOIN qrels r ON r.qid = run.qid AND r.did = run.did WHERE run.qid IN (SELECT qid FROM qrels)),
seen AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY place) AS found, did IN (SELECT did FROM qrels) AS known FROM hit),
ideal AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS place FROM qrels),
best AS (SELECT qid, k, sum(CASE WHEN place <= k AND rel > 0 THEN rel / log2(place + 1.0) ELSE 0 END) AS gain, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS relevant FROM ideal, ks GROUP BY qid, k),
got AS (SELECT qid, k, sum(CASE WHEN place <= k AND rel > 0 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN place <= k AND rel > 0 THEN found / place ELSE 0 END) AS ap,
          sum(CASE WHEN place <= k AND rel > 0 THEN rel / log2(place + 1.0) ELSE 0 END) AS gain, min(CASE WHEN place <= k AND rel > 0 THEN place END) AS first, sum(CASE WHEN place <= k AND NOT known THEN 1 ELSE 0 END) AS unknown FROM seen, ks GROUP BY qid, k),
one AS (SELECT k, coalesce(hits / nullif(relevant, 0), 0) AS recall, hits / k AS p, coalesce(ap / nullif(relevant, 0), 0) AS map, coalesce(got.gain / nullif(best.gain, 0), 0) AS ndcg, coalesce(1.0 / first, 0) AS mrr,
          hits / nullif(least(relevant, k), 0) AS r_cap, unknown / k AS hole, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS accuracy FROM got JOIN best USING (qid, k)),
agg AS (SELECT k, avg(recall) AS recall, avg(p) AS p, avg(map) AS map, avg(ndcg) AS ndcg, sum(mrr) / j.n AS mrr, coalesce(sum(r_cap), 0) / j.n AS r_cap, sum(hole) / j.n AS hole, sum(accuracy) / j.n AS accuracy FROM one, (SELECT count(DISTINCT qid) AS n FROM qrels) j GROUP BY k, j.n),
flat AS (UNPIVOT agg ON recall, p, map, ndcg, mrr, r_cap, hole, accuracy INTO NAME metric VALUE value)"""

_METRIC_ROWS = "SELECT metric, k::BIGINT AS k, round(value, 5) + 0.0 AS value FROM flat"
#: Hits of all of the run's queries, judged or not.
_HOLE = f"""{_JUDGED},
ks AS (SELECT unnest({KS}) AS k),
hit AS (SELECT did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS place FROM run),
holes AS (SELECT k, sum(CASE WHEN place <= k AND NOT EXISTS (SELECT 1 FROM qrels r WHERE r.did = hit.did) THEN 1 ELSE 0 END) AS unknown FROM hit, ks GROUP BY k)"""
_POSITIVES = "positives AS (SELECT DISTINCT qid, did FROM qrels WHERE rel > 0)"
_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\n\\t\\r]+'), lambda x: x <> '')"


def _sql_flagship() -> str:
    c = FLAGSHIP
    shifts = "value"
    for j in range(1, c.bits):
        shifts = f"xor({shifts}, value >> {j})"
    sides = ""
    for side, table, key in (("d", "documents", "doc_id"), ("q", "benchmark", "item_id")):
        sides += f""",
{side}w AS (SELECT {key} AS id, unnest({_WORDS}) AS tok FROM {table}),
{side}c AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % n AS vec_id, count(*) AS n FROM {side}w, n GROUP BY ALL),
{side}s AS (SELECT c.id, vp.rep, vp.part, vx.target AS i, sum(c.n * vx.y) AS x FROM {side}c c JOIN vp USING (vec_id) JOIN vx ON vx.vec_id = vp.vec_id AND vx.rep = vp.rep GROUP BY ALL),
{side}n AS (SELECT c.id, vp.rep, vp.part, sum(c.n) AS cnt FROM {side}c c JOIN vp USING (vec_id) GROUP BY ALL)"""
    return f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
planes(rep, bit, v) AS (VALUES {randmat.planes_sql(c)}),
tg(rep, i, target, sign) AS (VALUES {randmat.targets_sql(c)}),
vs AS (SELECT vec_id, rep, sum(CASE WHEN list_inner_product(embedding::DOUBLE[], v) > 0 THEN 1 << ({c.bits} - 1 - bit) ELSE 0 END)::BIGINT AS value FROM embeddings, planes GROUP BY ALL),
vp AS (SELECT vec_id, rep, {shifts} AS part FROM vs),
ve AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
vx AS (SELECT vec_id, rep, target, sum(x * sign) AS y FROM ve JOIN tg USING (i) GROUP BY ALL){sides},
da AS (SELECT id, rep, part, i, x / cnt AS x FROM ds JOIN dn USING (id, rep, part)),
sc AS (SELECT qs.id AS qid, da.id AS did, round(sum(qs.x * da.x), 9) AS score FROM qs JOIN da USING (rep, part, i) GROUP BY ALL),
rk AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM sc)
SELECT qid, did, rank::BIGINT AS rank FROM rk WHERE rank <= 10"""


def _sql_adaptive() -> str:
    w1, b1, w2, b2 = fusion.QueryAdaptive.seeded()._unpack()
    rows = lambda x: ", ".join(f"({', '.join(map(str, at))}, {float(v)!r})" for at, v in np.ndenumerate(x))
    return _select(
        f"""{SQL_E},
w1(j, h, y) AS (VALUES {rows(w1)}), b1(h, y) AS (VALUES {rows(b1)}), w2(h, o, y) AS (VALUES {rows(w2)}), b2(o, y) AS (VALUES {rows(b2)}),
part AS (SELECT id, 0 AS o, i, x FROM qm UNION ALL SELECT id, 1, i, x FROM qx WHERE pos = 0),
whole AS (SELECT id FROM part GROUP BY id HAVING count(DISTINCT o) = 2),
st AS (SELECT id, o AS j, avg(abs(x)) AS v FROM part GROUP BY id, o UNION ALL SELECT id, o + 2, sqrt(sum(x * x)) FROM part GROUP BY id, o),
mid AS (SELECT id, h, greatest(sum(v * w1.y) + b1.y, 0) AS v FROM st JOIN w1 USING (j) JOIN b1 USING (h) GROUP BY id, h, b1.y),
gate AS (SELECT id, o, 0.5 + 1 / (1 + exp(-(sum(v * w2.y) + b2.y))) AS w FROM mid JOIN w2 USING (h) JOIN b2 USING (o) GROUP BY id, o, b2.y)""",
        f"SELECT * FROM (SELECT id, (i + 64 * o)::BIGINT AS i, {R6.format('x * w')} AS value FROM part JOIN gate USING (id, o) WHERE id IN (SELECT id FROM whole)) WHERE value <> 0",
    )


_PASSAGES = _select(
    f"d AS (SELECT doc_id AS did, {_WORDS} AS w FROM documents), q AS (SELECT item_id AS qid, {_WORDS} AS w FROM benchmark), ds AS (SELECT DISTINCT did, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT did, w, unnest(range(1, len(w) - 6)) AS i FROM d)), qs AS (SELECT DISTINCT qid, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT qid, w, unnest(range(1, len(w) - 6)) AS i FROM q))",
    "SELECT DISTINCT qid, did, 1::BIGINT AS rel FROM qs JOIN ds USING (s)",
)


def _sql_flagship_retrieval() -> str:
    tail = _METRICS.removeprefix(_JUDGED).replace(f"unnest({KS})", "unnest([10])")
    return f"WITH found AS ({_sql_flagship()}),\nqrels AS ({_PASSAGES}),\nrun AS (SELECT qid, did, 11.0 - rank AS score FROM found){tail}\n{_METRIC_ROWS}"


def oracles() -> dict[str, str]:
    base = sql_sketch()
    out = {
        "mv_tokenise": _select(
            f"n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT doc_id, {_WORDS} AS words FROM documents), t AS (SELECT doc_id, unnest(words) AS tok, generate_subscripts(words, 1) - 1 AS pos FROM w), v AS (SELECT doc_id, pos, ('0x' || substr(md5(tok), 1, 8))::BIGINT % n AS vec_id FROM t, n)",
            "SELECT doc_id, count(*) AS tokens, count(DISTINCT vec_id) AS vectors, sum(vec_id * (pos % 97 + 1))::BIGINT AS checksum FROM v GROUP BY doc_id",
        ),
        "mv_pack_lengths": _select(SQL_E, "SELECT id, count(*) AS length FROM ct GROUP BY id"),
        "mv_gather_subset": _select(SQL_E, f"SELECT ord, ids.id, count(*) AS vectors, {R6.format('sum(vec[1]::DOUBLE)')} AS first_sum FROM (SELECT (37 * id) % n AS ord, id FROM (SELECT DISTINCT id FROM ct), n UNION ALL SELECT n + id, id FROM (SELECT DISTINCT id FROM ct), n WHERE id % 3 = 0) ids JOIN ct ON ct.id = ids.id GROUP BY ord, ids.id"),
        "simhash_part_index": _select(base, "SELECT id, pos, rep::BIGINT AS rep, value, part FROM cp"),
        "gray_label_alt": _select(base, "SELECT id, pos, rep::BIGINT AS rep, xor(low, low >> 1) AS label FROM cp"),
        "hamming_to_part": _select(base, "SELECT id, pos, rep::BIGINT AS rep, p AS part, bit_count(xor(value, xor(xor(p, p >> 1), p >> 2)))::BIGINT AS distance, bit_count(xor(value, xor(p, p >> 1)))::BIGINT AS inverse_distance FROM cp, (SELECT unnest(range(0, 8)) AS p)"),
        "partition_counts": _select(base, "SELECT id, rep::BIGINT AS rep, part, cnt FROM cc"),
        "distortion_bound": _select(base, f"SELECT rep::BIGINT AS rep, {R6.format('bound')} AS bound FROM bound"),
        "rep_ranking": _select(base, "SELECT rep, rep_pos FROM (SELECT rep::BIGINT AS rep, row_number() OVER (ORDER BY bound, rep) - 1 AS rep_pos FROM bound) WHERE rep_pos < 3"),
        "fde_query_sum": _select(base, _sql_long("qsum")),
        "fde_doc_avg": _select(base, _sql_long("cavg")),
        "fde_rep_select": _select(base, _sql_long("cavg", "rep IN (2, 0)")),
        "fde_query_rep_select": _select(base, _sql_long("qsum", "rep IN (2, 0)")),
        "fde_fill_empty": _select(base + _FILL, _sql_long("filled")),
        "fde_identity": _select(base, f"SELECT * FROM (SELECT p.id, p.rep::BIGINT AS rep, p.part, qx.i::BIGINT AS i, {R6.format('sum(x)')} AS value FROM qp p JOIN qx ON p.id = qx.id AND p.pos = qx.pos WHERE p.rep < 2 GROUP BY p.id, p.rep, p.part, qx.i) WHERE value <> 0"),
        "final_count_sketch": _sql_final(),
        "l2_normalise": _select(SQL_E, f"SELECT * FROM (SELECT id, i::BIGINT AS i, {R6.format('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12)')} AS value FROM cm) WHERE value <> 0"),
        "standardise": _select(
            base + _DENSE.replace("unnest(range(0, 4)) AS rep", "unnest(range(0, 2)) AS rep"),
            f"SELECT id, rep::BIGINT AS rep, (slot // 4)::BIGINT AS part, (slot % 4)::BIGINT AS i, {R6.format('(x - m) / (s + 1e-12)')} AS value FROM dense JOIN (SELECT rep, slot, avg(x) AS m, stddev_pop(x) AS s, max(abs(x)) AS big FROM dense GROUP BY rep, slot) USING (rep, slot) WHERE big > 0",
        ),
        "concat_fuse": _sql_concat("cm", "(SELECT id, i, x FROM cx WHERE pos = 0)"),
        "apply_scales": _sql_concat("cm", "(SELECT id, i, x FROM cx WHERE pos = 0)", True, str(SCALES[0]), str(SCALES[1])),
        "dimension_scales": _sql_concat("cm", "(SELECT id, i, x FROM cx WHERE pos = 0)", False, "(0.5 + (i % 7) / 7.0)", "(1.5 - ((i - 64) % 5) / 5.0)"),
        "block_gram": _select(base + _DENSE, f"SELECT * FROM (SELECT rep::BIGINT AS block, count(*) AS n, slot::BIGINT AS place, {R6.format('sum(x)')} AS value FROM dense GROUP BY rep, slot) WHERE value <> 0"),
        "block_cov_trace": _select(base + _DENSE, f"SELECT rep::BIGINT AS block, {R6.format('sum(v)')} AS trace, count(*) AS dimensions FROM (SELECT rep, slot, var_samp(x) AS v FROM dense GROUP BY rep, slot) GROUP BY rep"),
        "pca_transform": _select(_sql_project(), f"SELECT * FROM (SELECT id, j::BIGINT AS i, {R6.format('x')} AS value FROM pd) WHERE value <> 0"),
        "pca_inner_products": _select(_sql_project() + ",\n" + _sql_topk("pq", "pd", "j", 5), _HITS),
        "mips_topk": _select(SQL_E + ",\n" + _sql_topk("qm", "cm", "i", 10), _HITS),
        "run_construct": _select(SQL_E + ",\n" + _sql_topk("qm", "cm", "i", 10), "SELECT qid, did, rank::BIGINT AS rank, score FROM (SELECT qid, did, rank, (count(*) OVER (PARTITION BY qid) - (rank - 1))::DOUBLE AS score FROM hits) WHERE qid <> did"),
        "ranking_metrics": _select(_METRICS, _METRIC_ROWS),
        "positive_lists": _select(f"{_JUDGED}, {_POSITIVES}", "SELECT qid, did FROM positives"),
        "hard_negatives": _select(f"{_JUDGED.replace('rank <= 12', 'rank <= 20')}, {_POSITIVES}", "SELECT qid, did, rank::BIGINT AS rank FROM hits h WHERE qid IN (SELECT qid FROM positives) AND NOT EXISTS (SELECT 1 FROM positives p WHERE p.qid = h.qid AND p.did = h.did)"),
        "flagship_run": _sql_flagship(),
        "shared_passages": _PASSAGES,
        "flagship_retrieval": _sql_flagship_retrieval(),
        "adaptive_scales": _sql_adaptive(),
    }
    for same, as_ in (("partition_counts_bags", "partition_counts"), ("fde_tokens", "fde_doc_avg"), ("fde_fill_tokens", "fde_fill_empty"), ("final_count_sketch_tokens", "final_count_sketch"), ("mips_topk_columns", "mips_topk"), ("mips_pruned", "mips_topk")):
        out[same] = out[as_]
    for m in metrics.ALIASES:
        out[f"metric_{m}"] = _select(_METRICS, f"{_METRIC_ROWS} WHERE metric = '{m}'")
    out["metric_hole"] = _select(_HOLE, "SELECT 'hole' AS metric, k::BIGINT AS k, round(unknown / k / nullif(n, 0), 5) + 0.0 AS value FROM holes, (SELECT count(DISTINCT qid) AS n FROM qrels)")
    return out

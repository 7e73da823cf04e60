"""Ranking metrics over a run (qid, did, score) and judgements (qid, did, rel).

Hits rank by score, equal ones by id. Recall, P, MAP and NDCG are averaged over queries that are in both tables (a query without relevant
documents scores 0); MRR, Accuracy, R_cap and Hole are divided by the number of judged queries. R_cap leaves out queries without
relevant documents. Hole asked for alone counts the hits of all of the run's queries, judged or not. Values have five places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Names that a metric answers to.
ALIASES = {
    "recall": ("recall", "recall@k"),
    "p": ("p", "precision", "p@k"),
    "map": ("map", "map@k"),
    "ndcg": ("ndcg", "ndcg@k"),
    "mrr": ("mrr", "mrr@k", "mrr_cut"),
    "r_cap": ("r_cap", "recall_cap", "r_cap@k"),
    "hole": ("hole", "hole@k"),
    "accuracy": ("accuracy", "acc", "acc@k", "top_k_acc", "top_k_accuracy", "accuracy@k"),
}


def canonical(name: str) -> str:
    for own, names in ALIASES.items():
        if name.lower() in names:
            return own
    raise ValueError(f"unknown metric: {name}")


def drop_self_hits(run: DataFrame) -> DataFrame:
    return run.filter(F.col("qid").cast("string") != F.col("did").cast("string"))


def judged(run: DataFrame, qrels: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each judged query: place from 1, relevance (null: not judged for it), relevant so far."""
    hits = first_hits(run, qrels.select("qid").distinct(), most)
    hits = hits.join(pairs_in(qrels, hits).select("qid", "did", "rel"), ["qid", "did"], "left")
    return counted_hits(hits)


def first_hits(run: DataFrame, queries: DataFrame | None, most: int) -> DataFrame:
    """The first ``most`` hits of each of ``queries`` (None: of all), with their place from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    asked = run if queries is None else run.join(queries.select("qid"), "qid", "left_semi")
    return asked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def pairs_in(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (qid, did, ...) whose pair is in ``hits``.

    The hits of a query are few: they are one list, hashed by query, past which the pairs stream without being sorted; and
    pairs that are dealt by query already stay where they are.
    """
    lists = hits.groupBy("qid").agg(F.collect_set("did").alias("_dids")).hint("shuffle_hash")
    return pairs.join(lists, "qid").filter(F.array_contains("_dids", F.col("did"))).drop("_dids")


def counted_hits(hits: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("hit", F.when(F.col("rel") > 0, 1).otherwise(0)).withColumn("found", F.sum("hit").over(so_far))


def _relevant(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """For each judged query the number of relevant documents, and the ideal gain at each k.

    Judgements are counted by grade before they are ordered, and only as many places of a grade are laid out as the largest k has.
    """
    grades = qrels.groupBy("qid", "rel").agg(F.count("*").alias("many"))
    before = Window.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    grades = grades.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0)))
    last = F.least(F.col("before") + F.col("many"), F.lit(max(ks)).cast("long"))
    places = F.when(last > F.col("before"), F.sequence(F.col("before") + 1, last)).otherwise(F.expr("cast(array() as array<bigint>)"))
    grades = grades.withColumn("places", F.when(F.col("rel") > 0, places).otherwise(F.expr("cast(array() as array<bigint>)")))

    def ideal(k: int) -> Column:
        return F.sum(F.aggregate("places", F.lit(0.0), lambda s, p: s + F.when(p <= k, F.col("rel") / F.log2(p + 1.0)).otherwise(0.0)))

    return grades.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, F.col("many")).otherwise(0)).alias("relevant"), *[ideal(k).alias(f"ideal_{k}") for k in ks])


def per_query(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(qid, k, recall, p, map, ndcg, mrr, r_cap, hole, accuracy) of every query in both tables."""
    return _per_query(run, qrels, materialize(_relevant(qrels, ks), "judged-queries"), ks)


def _per_query(run: DataFrame, qrels: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    hits = materialize(first_hits(run, relevant, max(ks)), "judged-hits")
    hits = counted_hits(hits.join(pairs_in(qrels, hits).select("qid", "did", "rel"), ["qid", "did"], "left"))
    hits = hits.join(qrels.select("did").distinct().withColumn("known", F.lit(1)), "did", "left")
    in_k = lambda k, x: F.sum(F.when(F.col("place") <= k, x).otherwise(0.0))
    gain = F.col("hit") * F.coalesce("rel", F.lit(0)) / F.log2(F.col("place") + 1.0)
    aggs: list[Column] = []
    for k in ks:
        aggs += [
            in_k(k, F.col("hit")).alias(f"hits_{k}"),
            in_k(k, F.col("hit") * F.col("found") / F.col("place")).alias(f"ap_{k}"),
            in_k(k, gain).alias(f"gain_{k}"),
            F.min(F.when((F.col("place") <= k) & (F.col("hit") == 1), F.col("place"))).alias(f"first_{k}"),
            in_k(k, F.when(F.col("known").isNull(), 1).otherwise(0)).alias(f"unknown_{k}"),
        ]
    rows = hits.groupBy("qid").agg(*aggs).join(relevant, "qid")
    relevant = F.col("relevant")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    sets = []
    for k in ks:
        sets.append(
            F.struct(
                F.lit(k).alias("k"),
                zero(F.try_divide(F.col(f"hits_{k}"), relevant)).alias("recall"),
                (F.col(f"hits_{k}") / k).alias("p"),
                zero(F.try_divide(F.col(f"ap_{k}"), relevant)).alias("map"),
                zero(F.try_divide(F.col(f"gain_{k}"), F.col(f"ideal_{k}"))).alias("ndcg"),
                zero(1.0 / F.col(f"first_{k}")).alias("mrr"),
                F.try_divide(F.col(f"hits_{k}"), F.least(relevant, F.lit(k))).alias("r_cap"),
                (F.col(f"unknown_{k}") / k).alias("hole"),
                F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0).alias("accuracy"),
            )
        )
    return rows.select("qid", F.explode(F.array(*sets)).alias("m")).select("qid", "m.*")


def evaluate(run: DataFrame, qrels: DataFrame, ks: list[int] | tuple[int, ...] = (10,), ignore_identical: bool = True) -> DataFrame:
    """(metric, k, value): all metrics at every k."""
    ks = list(ks)
    if ignore_identical:
        run = drop_self_hits(run)
    relevant = materialize(_relevant(qrels, ks), "judged-queries")
    rows = _per_query(run, qrels, relevant, ks)
    judged_queries = relevant.agg(F.count("qid").alias("judged"))  # a row a query: the judgements are not gone through again
    names = ["recall", "p", "map", "ndcg", "mrr", "r_cap", "hole", "accuracy"]
    sums = rows.groupBy("k").agg(F.count("*").alias("both"), *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in names]).crossJoin(judged_queries)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.try_divide(F.col(m), F.col("both") if i < 4 else F.col("judged")), 5).alias("value")) for i, m in enumerate(names)])
    return sums.select("k", F.explode(pairs).alias("x")).select("x.metric", "k", "x.value")


def hole(run: DataFrame, qrels: DataFrame, ks: list[int] | tuple[int, ...]) -> DataFrame:
    """(metric, k, value): the share of documents that no query judges among the first k hits, summed over all of the run's queries, over the number of judged queries."""
    hits = first_hits(run, None, max(ks)).join(qrels.select("did").distinct().withColumn("known", F.lit(1)), "did", "left")
    unknown = [F.sum(F.when((F.col("place") <= k) & F.col("known").isNull(), 1).otherwise(0)) for k in ks]
    sums = hits.agg(F.count("*").alias("hits"), *[x.alias(f"unknown_{k}") for k, x in zip(ks, unknown, strict=True)]).filter("hits > 0")
    rows = sums.crossJoin(qrels.agg(F.count_distinct("qid").alias("judged")))
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.try_divide(F.col(f"unknown_{k}") / k, F.col("judged")), 5).alias("value")) for k in ks])
    return rows.select(F.explode(values).alias("x")).select(F.lit("hole").alias("metric"), "x.k", "x.value")


def evaluate_one(run: DataFrame, qrels: DataFrame, ks: list[int], metric: str) -> DataFrame:
    """One metric by any of its names; the run is taken as it is."""
    own = canonical(metric)
    return hole(run, qrels, ks) if own == "hole" else evaluate(run, qrels, ks, ignore_identical=False).filter(F.col("metric") == own)

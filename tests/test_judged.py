"""Judgements of all pairs: nothing of the size of the pairs is shuffled, sorted or held."""

import math

import pytest

from bagfold import catalog
from bagfold.operators import fusion, metrics


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("judged"))
    spark.range(400).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(sin(id * i) as float)) as embedding").write.parquet(f"{path}/embeddings.parquet")
    return path


def _above(frame):
    """The plan from its top to where pairs are made."""
    return frame._jdf.queryExecution().executedPlan().toString().split("NestedLoopJoin")[0]


def test_pairs_stay_where_they_are_made(spark, folder):
    pairs = catalog.positive_lists(spark, folder)
    assert "Exchange" not in _above(pairs) and "Aggregate" not in _above(pairs)
    assert pairs.rdd.getNumPartitions() > 4  # not one task for all the pairs of few ids
    assert pairs.count() == pairs.distinct().count() > 500
    hits = spark.createDataFrame([(0, 1), (3, 1)], "qid long, did long")
    found = metrics.pairs_in(catalog._qrels_e(spark, folder), hits)
    assert "Exchange" not in _above(found) and "Sort" not in _above(found)


def test_relevant_equals_plain(spark):
    rows = [(1, 1, 3), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 3), (2, 1, 0), (2, 2, None), (3, 1, -1), (3, 2, 2), (3, 2, 2)]
    qrels = spark.createDataFrame(rows, "qid long, did long, rel int")
    plan = metrics._relevant(qrels, [1, 3, 10])
    for r in plan.collect():
        own = sorted((x for q, _, x in rows if q == r.qid and x is not None), reverse=True)
        assert r.relevant == sum(x > 0 for x in own)
        for k in (1, 3, 10):
            assert math.isclose(r[f"ideal_{k}"], sum(x / math.log2(i + 2) for i, x in enumerate(own[:k]) if x > 0), abs_tol=1e-12)
    # counted by grade before anything is ordered: the window lies above an aggregation
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text.split("Window")[-1]


def test_pairs_in_keeps_repeats_and_drops_others(spark):
    pairs = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 2, 1), (2, 1, 1), (None, 1, 1), (1, None, 1)], "qid long, did long, rel int")
    hits = spark.createDataFrame([(1, 1), (1, 1), (2, 9), (None, 1)], "qid long, did long")
    assert sorted((r.qid, r.did, r.rel) for r in metrics.pairs_in(pairs, hits).collect()) == [(1, 1, 0), (1, 1, 2)]
    found = spark.createDataFrame([(1, 1), (1, 2), (4, 4)], "qid long, did long")
    hits = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 1, 1), (4, 5, 1)], "qid long, did long, rank int")
    assert sorted((r.qid, r.did) for r in fusion.hard_negatives(hits, found).collect()) == [(1, 3), (4, 5)]


def test_judged_queries_are_counted_without_the_pairs(spark, folder):
    """The count of judged queries comes from the table of a row a query, not from all pairs once more; a null query is none."""
    run = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "qid long, did long, score double")
    qrels = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 2, 0), (None, 1, 1)], "qid long, did long, rel int")
    got = {r.metric: r.value for r in metrics.evaluate(run, qrels, [1, 2], ignore_identical=False).filter("k = 2").collect()}
    assert got["mrr"] == 0.25 and got["accuracy"] == 0.5 and got["recall"] == 1.0
    plan = metrics.evaluate(run, catalog._qrels_e(spark, folder), [10])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoopJoin") == 3  # pairs for hits and for known documents, and the one row of the count


def test_means_make_no_row_a_number(spark, folder):
    """Bags are averaged whole; null numbers, null vectors and short ones count as before, and bags without numbers have no mean."""
    rows = [(1, [1.0, None, 3.0]), (1, [2.0, None]), (1, None), (2, None), (3, []), (4, [5.0]), (4, [0.5, 1.0]), (None, [2.0]), (None, [4.0])]
    means = catalog.means_e(spark.createDataFrame(rows, "id long, vec array<float>"))
    assert {r.id: r.vec for r in means.collect()} == {1: [1.5, None, 3.0], 4: [2.75, 1.0], None: [3.0]}
    plan = catalog._means(spark, folder)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_hole_counts_hits_of_queries_that_are_not_judged(spark):
    """Hole by name: all of the run's queries give hits, only judged ones are divided by."""
    run = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 2.0), ("b", "z", 2.0), ("b", "x", 1.0), ("c", "z", 2.0), ("c", "y", 1.0)], "qid string, did string, score double")
    qrels = spark.createDataFrame([("a", "x", 1), ("d", "w", 0)], "qid string, did string, rel int")
    for name in ("hole", "Hole@k"):
        assert {r.k: (r.metric, r.value) for r in metrics.evaluate_one(run, qrels, [1, 2], name).collect()} == {1: ("hole", 1.0), 2: ("hole", 1.0)}
    assert {r.k: r.value for r in metrics.evaluate(run, qrels, [1, 2], ignore_identical=False).filter("metric = 'hole'").collect()} == {1: 0.0, 2: 0.25}
    assert {r.k: r.value for r in metrics.evaluate_one(run, qrels.limit(0), [2], "hole").collect()} == {2: None}
    assert metrics.evaluate_one(run.limit(0), qrels, [2], "hole").count() == 0


def test_passages_are_looked_for_once(spark, monkeypatch):
    """What the metrics read are the judgements found, not the documents' texts again."""
    read = []
    evaluate = metrics.evaluate
    monkeypatch.setattr(metrics, "evaluate", lambda run, qrels, *a, **k: read.append(qrels.inputFiles()) or evaluate(run.limit(0), qrels.limit(0), *a, **k))
    catalog.flagship_retrieval(spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and read[0] and not any("documents" in f or "benchmark" in f for f in read[0])

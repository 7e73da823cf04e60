"""Exact search by blocks and bounds, and search along a graph, against NumPy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagfold import catalog
from bagfold.operators import blockjoin, graph, search
from bagfold.plans import retrieval


def frames(spark, q, d, ids=int):
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, vec array<double>")
    kind = "long" if ids is int else "string"
    return asked, spark.createDataFrame([(ids(i), x.tolist()) for i, x in enumerate(d)], f"did {kind}, vec array<double>").repartition(3)


def plain(q, d, k, ids=int):
    scores = q @ d.T
    return {(i, r + 1): ids(j) for i in range(len(q)) for r, j in enumerate(sorted(range(len(d)), key=lambda j: (-scores[i, j], ids(j)))[:k])}


def got(hits):
    return {(r.qid, r["rank"]): r.did for r in hits.collect()}


def skewed(draw, n, size=8):
    """Integers, so that products are exact and ties real; norms differ by a factor of thousands."""
    return draw.integers(-4, 5, (n, size)) * (1 + (2.0 ** draw.integers(0, 12, n)).astype(int))[:, None].astype(float)


@pytest.mark.parametrize("cell_rows", [None, 7, 50, 1000])
def test_pruned_equals_exact_and_skips(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(blockjoin, "BLOCK", 16)
    draw = np.random.default_rng(2)
    q, d = draw.integers(-3, 4, (23, 8)).astype(float), skewed(draw, 400)
    q[3] = 0
    d[17] = d[5] = d[300]
    for k in (1, 10):
        asked, docs = frames(spark, q, d)
        out = search.exact_pruned(asked, docs, k, cell_rows)
        assert got(out.hits) == plain(q, d, k) == got(search.exact(asked, docs, k))
        assert out.all == 23 * 400 and 0 < out.made < 0.8 * out.all


def test_pruned_with_equal_norms_and_few_documents(spark):
    draw = np.random.default_rng(3)
    d = draw.normal(size=(60, 5))
    d /= np.linalg.norm(d, axis=1)[:, None]
    q = draw.normal(size=(4, 5))
    asked, docs = frames(spark, q, d, str)
    out = search.exact_pruned(asked, docs, 100, 13)
    assert got(out.hits) == plain(q, d, 100, str) and out.made == out.all == 240
    for some, every in ((asked.limit(0), docs), (asked, docs.limit(0))):
        empty = search.exact_pruned(some, every, 3)
        assert empty.hits.count() == 0 and empty.hits.columns == ["qid", "did", "rank", "score"] and empty.made == 0


def test_nulls_repeated_ids_and_rounding(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, vec array<double>")
    docs = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [2.0, 0.0]), ("b", None), ("c", [2.0 + 1e-12, 1.0])], "did string, vec array<double>")
    for hits in (search.exact(asked, docs, 5), search.exact_pruned(asked, docs, 5).hits):
        assert [(r.qid, r.did, r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, "c", 1), (1, "a", 2), (1, "a", 3)]
    assert [r.did for r in search.exact(asked, docs, 2, 9).orderBy("rank").collect()] == ["a", "c"]


def test_no_query_reaches_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    draw = np.random.default_rng(4)
    asked, docs = frames(spark, draw.normal(size=(500, 6)), draw.normal(size=(300, 6)))

    def guarded(name):
        own = getattr(DataFrame, name)

        def call(self, *a, **b):
            assert not {"qid", "qvec"} & set(self.columns), f"{name} of queries"
            return own(self, *a, **b)

        return call

    with monkeypatch.context() as m:
        for name in ("collect", "toArrow", "toPandas", "toLocalIterator", "take", "head"):
            m.setattr(DataFrame, name, guarded(name))
        hits = search.exact(asked, docs, 3)
        hits.write.format("noop").mode("overwrite").save()
        search.exact_pruned(asked, docs, 3).hits.write.format("noop").mode("overwrite").save()
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def text_vectors(spark, folder):
    """Mean vectors of the documents and of the benchmark passages."""
    docs, items, vectors = catalog._texts(spark, folder)
    d = retrieval.single_vectors(docs, vectors, "doc_id").select(F.col("id").alias("did"), F.col("sv").alias("vec"))
    return retrieval.single_vectors(items, vectors, "item_id").select(F.col("id").alias("qid"), F.col("sv").alias("vec")), d


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_graph_finds_nine_tenths_and_meets_a_fifth(spark, tmp_path, scale):
    folder = f"/root/testdata/sf{scale}"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    asked, docs = text_vectors(spark, folder)
    asked.write.parquet(f"{tmp_path}/q")
    docs.write.parquet(f"{tmp_path}/d")
    asked, docs = spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/d")
    graph.GraphIndex.build(docs, f"{tmp_path}/index")
    found = graph.GraphIndex(spark, f"{tmp_path}/index").search(asked, 10)  # as another session would
    exact = search.exact_pruned(asked, docs, 10)
    recall = search.overlap(found.hits, exact.hits)
    print(f"sf{scale}: recall {recall:.3f}, {found.made / found.all:.3f} of the documents; exact by bounds {exact.made / exact.all:.3f}")
    assert recall >= 0.9 and found.made <= found.all / 5


def test_graph_over_lots_with_copies(spark, tmp_path):
    draw = np.random.default_rng(5)
    d = draw.normal(size=(600, 6)) * draw.lognormal(0, 1, 600)[:, None]
    d[100:350] = d[7]  # many copies of one vector
    q = draw.normal(size=(70, 6))
    asked, docs = frames(spark, q, d, str)
    docs = docs.unionByName(spark.createDataFrame([("none", None)], docs.schema))
    index = graph.GraphIndex.build(docs, f"{tmp_path}/index", lot_rows=100)
    assert index.documents == 600 and index.lots == 6
    found = index.search(asked, 20)
    truth = plain(q, d, 20, str)
    hits = {(r.qid, r.did): r.score for r in found.hits.collect()}
    assert len(hits) == 70 * 20 and all(abs(s - q[i] @ d[int(j)]) < 1e-9 for (i, j), s in hits.items())
    assert sum((i, j) in hits for (i, _), j in truth.items()) / len(truth) >= 0.9
    # built again in its place
    again = graph.GraphIndex.build(docs.limit(50), f"{tmp_path}/index")
    assert again.documents == 50 and again.lots == 1


def test_graph_of_one_and_none(spark, tmp_path):
    asked, docs = frames(spark, np.ones((2, 3)), np.ones((1, 3)))
    found = graph.GraphIndex.build(docs, f"{tmp_path}/index").search(asked, 5)
    assert got(found.hits) == {(0, 1): 0, (1, 1): 0} and found.made == found.all == 2
    with pytest.raises(ValueError):
        graph.GraphIndex.build(docs.limit(0), f"{tmp_path}/none")


def test_neighbours_by_hand():
    x = np.array([[10.0, 0], [1, 0], [0, 1], [0, 2]])
    links = graph.neighbours(x, 1, 3)
    assert links[:, 0].tolist()[1:] == [0, 3, 2] and set(links[0].tolist()) >= {1}
    assert graph.neighbours(x[:1], 4, 2).tolist() == [[-1, -1]]

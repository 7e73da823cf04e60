"""Search by column expressions: waves of blocks under each query's floor."""

import numpy as np

from bagfold.operators import search


def _rows(rows):
    return sorted((r.qid, r.rank, r.did, round(r.score, 9)) for r in rows.collect())


def test_waves_equal_the_block_join(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(90, 6)), 1) * draw.choice([0.2, 1.0, 3.0], size=(90, 1))
    x[40:60] = x[:20]  # copies tie by id
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "did long, vec array<double>")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.round(draw.normal(size=(25, 6)), 1))], "qid long, vec array<double>")
    whole = _rows(search.exact(asks, docs, 3, 9))
    monkeypatch.setattr(search, "ARRAY_ROWS", 80)  # cells are cut by a sample: the first wave (64 rows) leaves a rest
    assert _rows(search.exact_sql(asks, docs, 3)) == whole
    monkeypatch.setattr(search, "ARRAY_ROWS", 7)
    monkeypatch.setattr(search, "WAVES", 2)
    assert _rows(search.exact_sql(asks, docs, 3)) == whole


def test_odd_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [5.0]), (4, [None, 3.0])], "did long, vec array<double>")
    asks = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [-1.0, 0.0])], "qid long, vec array<double>")
    assert _rows(search.exact_sql(asks, docs, 2)) == [(1, 1, 3, 5.0), (1, 2, 1, 3.0), (3, 1, 4, 0.0), (3, 2, 1, -1.0)]
    assert search.exact_sql(asks.filter("qid > 9"), docs, 2).count() == search.exact_sql(asks, docs.filter("did > 9"), 2).count() == 0

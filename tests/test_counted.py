"""Counted texts over a dictionary give what the bags of their vectors give."""

import os

import numpy as np
import pytest

from bagfold import catalog
from bagfold.config import RetrievalSettings
from bagfold.plans import retrieval

FOLDER = "/root/testdata/sf0.001"
SETTINGS = RetrievalSettings(choose_rate=0.5, repetitions=6, bits=2, projection_dimension=4, keep_dimensions=20, sampling_rate=0.5, top_k=10)


@pytest.fixture(scope="module")
def forms(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("the test tables are not here")
    docs, items, vectors = catalog._texts(spark, FOLDER)
    docs = docs.unionByName(spark.createDataFrame([(10_001, ""), (10_002, None)], docs.schema))
    n = vectors.count()
    table = vectors.orderBy("vec_id").toArrow()
    words = table.column(0).to_numpy(), np.stack(table.column(1).to_numpy())
    counted = [retrieval.counted_texts(x, n, i, empty=True) for x, i in ((docs, "doc_id"), (items, "item_id"))]
    return [retrieval.text_bags(x, vectors, i) for x, i in ((docs, "doc_id"), (items, "item_id"))], counted, words


def test_means(spark, forms):
    bags, counted, words = forms
    one = {r.id: r.sv for r in retrieval.bag_means(bags[0], 64).collect()}
    two = {r.id: r.sv for r in retrieval.counted_means(counted[0], words).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[i], two[i], atol=1e-9) for i in one)
    assert not any(two[10_001]) and not any(two[10_002])


@pytest.mark.parametrize("hybrid", [True, False])
def test_plans(spark, forms, hybrid):
    bags, counted, words = forms
    one, two = retrieval.offline(bags[0], 64, SETTINGS, hybrid), retrieval.offline(counted[0], 64, SETTINGS, hybrid, words)
    assert one.reps == two.reps and np.allclose(np.abs(one.model.weights), np.abs(two.model.weights), atol=1e-6)
    x, y = ({r.did: np.abs(r.vec) for r in b.documents.collect()} for b in (one, two))
    assert x.keys() == y.keys() and all(np.allclose(x[i], y[i], atol=1e-6) for i in x)
    q, r = ({r.qid: np.abs(r.vec) for r in retrieval.query_vectors(b, side).collect()} for b, side in ((one, bags[1]), (two, counted[1])))
    assert q.keys() == r.keys() and all(np.allclose(q[i], r[i], atol=1e-6) for i in q)


def _plain(rows):
    return sorted((r.id is not None, r.id or 0, sorted(zip(r.vec_ids, r.times, strict=True))) for r in rows.collect())


@pytest.mark.parametrize("empty", [True, False])
def test_texts_are_counted_where_they_lie(spark, empty):
    texts = spark.createDataFrame([(1, "a B b  c\tA"), (2, None), (3, " \n"), (4, "x")], "doc_id long, text string")
    counted = retrieval.counted_texts(texts, 7, "doc_id", empty=empty)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert _plain(counted) == _plain(retrieval._counted_together(texts, 7, "doc_id", "text", empty))
    odd = texts.unionByName(spark.createDataFrame([(1, "b d"), (None, "e"), (None, "e f"), (2, "")], texts.schema))
    assert _plain(retrieval.counted_texts(odd, 7, "doc_id", empty=empty)) == _plain(retrieval._counted_together(odd, 7, "doc_id", "text", empty))


def test_tokens_of_repeated_ids_count_together(spark, tmp_path):
    spark.createDataFrame([(1, "a b b"), (1, "b c"), (2, "a  a\n"), (3, None), (None, "d"), (None, "d e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i)] * 64) for i in range(97)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.mv_tokenise(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, catalog._tokenised_together(docs, 97).collect())) and got.count() == 3
    spark.createDataFrame([(1, "a b b"), (2, "a")], docs.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in catalog.mv_tokenise(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_a_large_dictionary_is_worked_out_by_batch(spark, forms, monkeypatch):
    _, counted, words = forms
    config, batch, runs = catalog.FLAGSHIP, counted[1].toArrow().combine_chunks().to_batches()[0], []
    for most in (retrieval.LOOKED_BYTES, 0):
        monkeypatch.setattr(retrieval, "LOOKED_BYTES", most)
        some = retrieval._Looked(*words, 8, lambda v: v)
        assert (some.all is None) == (most == 0)
        table, which = some.of(np.array([words[0][3], words[0][1], words[0][3]]))
        assert (table[which] == words[1][[3, 1, 3]]).all()
        runs.append(retrieval._counted_encoder(config, config.chosen(None), *words)(batch))
    assert np.array_equal(*runs) and runs[0].any()
    many = spark.range(60_000).selectExpr("id as vec_id", "array_repeat(cast(id as float), 64) as embedding")
    ids, vectors = retrieval.dictionary(many, 64)  # too many in round 3
    assert len(ids) == 60_000 and vectors.dtype == np.float32 and (vectors[:, 0] == ids).all()


def test_sampled_rows_are_those_of_the_sampled_ids(spark):
    from bagfold.sources import tokens as tk

    rows = spark.range(3000).selectExpr("if(id % 50 = 0, null, id % 2900) as id", "id as other")
    for rate in (0.0, 0.37, 1.0):
        want = rows.join(tk.sample_ids(rows, rate, 5), "id", "left_semi").select("other").collect()
        assert sorted(r.other for r in tk.sampled_rows(rows, rate, 5).collect()) == sorted(r.other for r in want)

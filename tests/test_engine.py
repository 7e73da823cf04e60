"""The retrieval engine against plain NumPy versions, hand-made cases and properties."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagfold.config import DATASETS, EncoderConfig, Encoding, FillTarget, Projection, RetrievalSettings, dataset_settings
from bagfold.functions import randmat, sketch
from bagfold.operators import blockjoin, encode as enc
from bagfold.operators import fusion, metrics, pca, search, select, stats
from bagfold.plans import retrieval
from bagfold.sources import arrays
from bagfold.sources import collections as beir
from bagfold.sources import tokens as tk
from helpers import bits_of, encode_plain, part_of, prefix_xor

AMS = EncoderConfig(8, 3, 3, 42, Encoding.AVERAGE, Projection.AMS, 4)


def bags(n=30, dimension=8, seed=0, most=7):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=(0 if i % 10 == 0 else draw.integers(1, most), dimension)).astype(np.float32)) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return bags(), tk.from_arrays(spark, bags()).repartition(3)


# ---- configuration


def test_config_checks():
    with pytest.raises(ValueError):
        EncoderConfig(8, 3, 32)
    with pytest.raises(ValueError):
        EncoderConfig(8, 3, -1)
    with pytest.raises(ValueError):
        EncoderConfig(8, 3, 2, projection=Projection.AMS)
    with pytest.raises(ValueError):
        AMS.chosen([])
    with pytest.raises(ValueError):
        AMS.chosen([0, 3])
    with pytest.raises(ValueError):
        AMS.for_documents(fill=True).for_queries()
    assert EncoderConfig(8, 3, 0).buckets == 1 and AMS.block == 32 and EncoderConfig().dimension == 128
    assert dataset_settings("fiqa").repetitions == 20 and dataset_settings("other").choose_rate == 0.1 and "scidocs" in DATASETS


# ---- sketches


@given(st.integers(0, 2**12 - 1))
@settings(deadline=None, max_examples=50)
def test_fold_is_prefix_xor(n):
    bits = [(n >> s) & 1 for s in range(11, -1, -1)]
    assert part_of(bits) == prefix_xor(n)
    p = prefix_xor(n)
    assert p ^ (p >> 1) == n


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5])
def test_buckets_and_labels(spark, k):
    config = EncoderConfig(8, 2, k, 7)
    draw = np.random.default_rng(1)
    rows = [(0, i, draw.normal(size=8).astype(np.float32)) for i in range(40)] + [(0, 40, np.zeros(8, np.float32))]
    tokens = spark.createDataFrame([(i, p, v.tolist()) for i, p, v in rows], "id long, pos int, vec array<float>")
    for r in enc.sketched(tokens, config).collect():
        bits = bits_of(rows[r.pos][2], randmat.hyperplanes(config, r.rep))
        value = sum(b << (k - 1 - j) for j, b in enumerate(bits))
        low = sum(b << j for j, b in enumerate(bits))
        assert (r.value, r.part, r.label) == (value, part_of(bits), low ^ (low >> 1))
        if r.pos == 40:
            assert r.part == 0  # a sketch of exactly 0 is no positive bit


def test_distance_targets_agree_up_to_two_bits(spark):
    grid = spark.range(8).select(F.col("id").cast("int").alias("v")).crossJoin(spark.range(8).select(F.col("id").cast("int").alias("p")))
    for k, same in ((2, True), (3, False)):
        rows = grid.filter((F.col("v") < 2**k) & (F.col("p") < 2**k)).select(sketch.bucket_distance(F.col("v"), F.col("p"), k).alias("a"), sketch.bucket_distance(F.col("v"), F.col("p"), k, inverse=True).alias("b")).collect()
        assert all(r.a == r.b for r in rows) == same


# ---- encoders


@pytest.mark.parametrize("config", [AMS, EncoderConfig(8, 2, 0), EncoderConfig(8, 2, 1), EncoderConfig(8, 3, 3, 5, Encoding.AVERAGE)])
@pytest.mark.parametrize("reps", [None, [1, 0]])
def test_encode_equals_plain(corpus, config, reps):
    items, frame = corpus
    chosen = config.chosen(reps)
    for kind in ("query", "document"):
        for r in enc.encode(frame, config, reps, kind).collect():
            want, counts = encode_plain(items[r.id][1], config, lambda x: randmat.hyperplanes(config, x), lambda x: randmat.projection_matrix(config, x), chosen, kind == "document")
            assert np.allclose(r.fde, want.reshape(-1), atol=1e-12) and list(r.sizes) == counts.reshape(-1).tolist()
            assert sum(r.sizes) == len(chosen) * len(items[r.id][1])
        long = enc.to_long(enc.encode(frame, config, reps, kind), config, reps)
        tokens = enc.encode_tokens(tk.explode_bags(frame), config, reps, kind)
        a = {(r.id, r.rep, r.part, r.i): r.value for r in long.collect()}
        b = {(r.id, r.rep, r.part, r.i): r.value for r in tokens.collect() if abs(r.value) > 0}
        assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-9 for x in a)


@pytest.mark.parametrize("aim", list(FillTarget))
def test_fill(corpus, aim):
    items, frame = corpus
    config = EncoderConfig(8, 2, 3, 42, Encoding.AVERAGE, Projection.AMS, 4, fill_empty=True, fill_target=aim)
    got = {r.id: np.array(r.fde) for r in enc.encode(frame, config).collect()}
    long = {(r.id, r.rep, r.part, r.i): r.value for r in enc.encode_tokens(tk.explode_bags(frame), config).collect()}
    for i, bag in items:
        want, _ = encode_plain(bag, config, lambda x: randmat.hyperplanes(config, x), lambda x: randmat.projection_matrix(config, x), [0, 1], True, True, aim is FillTarget.INVERSE)
        assert np.allclose(got[i], want.reshape(-1), atol=1e-12)
        for (r, p, x), v in np.ndenumerate(want):
            assert abs(long.get((i, r, p, x), 0.0) - v) < 1e-9


def test_fill_with_all_points_in_one_bucket(spark):
    same = np.ones((3, 8), np.float32) * np.array([[1.0], [2.0], [3.0]], np.float32)
    config = EncoderConfig(8, 1, 3, 42, Encoding.AVERAGE, fill_empty=True)
    out = np.array(enc.encode(tk.from_arrays(spark, [(0, same)]), config).first().fde).reshape(8, 8)
    part = part_of(bits_of(same[0], randmat.hyperplanes(config, 0)))
    assert np.allclose(out[part], 2) and all(np.allclose(out[p], 1) for p in range(8) if p != part)  # ties: the first vector


def test_query_fill_and_wrong_width(spark, corpus):
    with pytest.raises(ValueError):
        enc.encode(corpus[1], AMS.for_documents(fill=True), kind="query")
    with pytest.raises(Exception, match="8 numbers"):
        enc.encode(tk.from_arrays(spark, [(0, np.ones((2, 5)))]), AMS).collect()
    with pytest.raises(Exception, match="should have 8 numbers"):
        tk.explode_bags(tk.from_arrays(spark, [(0, np.ones((2, 5)))]), dimension=8).collect()


def test_order_and_subset_and_empty(corpus):
    items, frame = corpus
    turned = frame.withColumn("vecs", F.reverse("vecs"))
    a, b = ({r.id: np.array(r.fde) for r in enc.encode(f, AMS).collect()} for f in (frame, turned))
    assert all(np.allclose(a[i], b[i]) for i in a)
    part = {r.id: np.array(r.fde) for r in enc.encode(frame, AMS, [2, 0]).collect()}
    assert all(np.allclose(part[i], np.concatenate([a[i][64:96], a[i][:32]])) for i in a)
    empty = [i for i, bag in items if not len(bag)]
    assert empty and all(not a[i].any() for i in empty)
    assert enc.encode(frame, AMS, without_empty=True).count() == len(items) - len(empty)


def test_final_count_sketch_is_one_linear_map(corpus):
    items, frame = corpus
    config = EncoderConfig(8, 2, 2, 42, final_dimension=5)
    flat = {r.id: np.array(r.fde) for r in enc.encode(frame, EncoderConfig(8, 2, 2, 42)).collect()}
    target, sign = randmat.signed_targets(64, 5, 42)
    for r in enc.encode(frame, config).collect():
        want = np.zeros(5)
        np.add.at(want, target, sign * flat[r.id])
        assert np.allclose(r.fde, want)


def test_dictionary_encoding_equals_bags(spark):
    draw = np.random.default_rng(3)
    words = (np.arange(10, 30), draw.normal(size=(20, 8)))
    config = EncoderConfig(8, 3, 3, 42, Encoding.AVERAGE, Projection.AMS, 4)
    rows = [(i, draw.choice(words[0], 5, replace=False).tolist(), draw.integers(1, 4, 5).tolist()) for i in range(12)]
    counted = spark.createDataFrame(rows, "id long, vec_ids array<long>, times array<long>")
    lists = tk.from_arrays(spark, [(i, np.repeat(words[1][np.array(v) - 10], t, axis=0)) for i, v, t in rows])
    wide = lists.withColumn("vecs", F.col("vecs"))
    got = retrieval.encoded_search(counted, counted, (words[0], words[1].astype(np.float32).astype(float)), config, 4).collect()
    q = enc.encode(wide, config, kind="query").select(F.col("id").alias("qid"), F.col("fde").alias("vec"))
    d = enc.encode(wide, config, kind="document").select(F.col("id").alias("did"), F.col("fde").alias("vec"))
    want = search.exact(q, d, 4).collect()
    assert {(r.qid, r.rank): r.did for r in got} == {(r.qid, r.rank): r.did for r in want}


# ---- tokens and collections


def test_pack_and_gather_and_sample(spark, corpus, tmp_path):
    items, frame = corpus
    tokens = tk.explode_bags(frame)
    back = {r.id: np.array(r.vecs, np.float32).reshape(-1, 8) for r in tk.pack(tokens, frame).collect()}
    assert all(np.array_equal(back[i], bag) for i, bag in items)
    assert {r.id: r.length for r in tk.lengths(frame).collect()} == {i: len(bag) for i, bag in items}
    assert tk.drop_empty(frame).count() == sum(len(b) > 0 for _, b in items)
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "ord long, id long")
    assert [r.id for r in tk.gather(tokens, ids).groupBy("ord", "id").count().orderBy("ord").collect()] == [7, 3, 7]
    assert tk.sample_ids(frame, 0.5, 1).count() == 15 and tk.sample_ids(frame, 0.0, 1).count() == 1
    assert sorted(r.id for r in tk.sample_ids(frame, 0.3, 4).collect()) == sorted(r.id for r in tk.sample_ids(frame.repartition(5), 0.3, 4).collect())
    assert tk.split_suffix("dev") == "" and tk.split_suffix("train") == "_train"
    path = f"{tmp_path}/mv"
    with pytest.raises(FileNotFoundError):
        tk.ensure_saved(spark, path, lambda: None)
    assert tk.ensure_saved(spark, path, lambda: frame).count() == len(items)
    assert tk.ensure_saved(spark, path, lambda: 1 / 0).count() == len(items)
    with pytest.raises(Exception, match="isn't 9 wide"):
        tk.load_bags(spark, path, 9).collect()


def test_collections(spark, tmp_path, monkeypatch):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "a"}\n{"_id": "d2", "text": "b"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n{"_id": "q2", "text": "y"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    corpus, queries, qrels = beir.load(spark, str(tmp_path), "test")
    assert corpus.count() == 2 and [r.qid for r in queries.collect()] == ["q1"] and qrels.first().rel == 1
    assert beir.default_split("msmarco_small") == "dev" and beir.default_split("fiqa") == "test"
    monkeypatch.setenv("COLLECTIONS", "/env")
    assert beir.resolve("x", None, "COLLECTIONS", "/d") == "/env/x" and beir.resolve("x", "/a/", "COLLECTIONS", "/d") == "/a/x"
    spark.createDataFrame([("d1", [1.0, 2.0])], "id string, sv array<double>").write.parquet(f"{tmp_path}/sv")
    assert beir.load_single_vectors(spark, f"{tmp_path}/sv").first().sv == [1.0, 2.0]
    with pytest.raises(ValueError):
        beir.load_single_vectors(spark, f"{tmp_path}/sv", corpus, "did")


# ---- selection and statistics


def test_bound_and_ranking(spark, corpus):
    items, frame = corpus
    counts = retrieval.counts_of_bags(frame, AMS)
    again = enc.partition_counts(tk.explode_bags(frame), AMS)
    key = lambda f: sorted((r.id, r.rep, r.part, r.cnt) for r in f.collect())
    assert key(counts) == key(again)
    dense = np.zeros((3, len(items), 8))
    for r in counts.collect():
        dense[r.rep, r.id, r.part] = r.cnt
    want = {r: 2 - 2 * (1 / np.maximum(1, dense[r])).mean(0).min() for r in range(3)}
    got = {r.rep: r.bound for r in select.distortion_bound(counts, len(items)).collect()}
    assert all(abs(got[r] - want[r]) < 1e-12 and 0 <= got[r] < 2 for r in want)
    assert select.chosen(select.distortion_bound(counts, len(items)), 2) == sorted(want, key=lambda r: (want[r], r))[:2]
    assert select.keep_count(160, 0.1) == 16 and select.keep_count(3, 0.1) == 1


def test_standardise_counts_absent_numbers_as_zero(spark):
    long = spark.createDataFrame([(0, 0, 0, 0, 2.0), (1, 0, 0, 0, 4.0), (0, 0, 0, 1, 5.0), (1, 0, 0, 1, 5.0), (2, 0, 0, 1, 5.0)], "id long, rep int, part int, i int, value double")
    ids = spark.range(3).select("id")
    out = {(r.id, r.i): r.value for r in stats.standardised(long, ids).collect()}
    x = np.array([2.0, 4.0, 0.0])
    want = (x - x.mean()) / (x.std() + 1e-12)
    assert all(abs(out[i, 0] - want[i]) < 1e-9 for i in range(3)) and len(out) == 6
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, vec array<double>")
    assert np.allclose([r.vec for r in stats.l2_normalise(zero).orderBy("id").collect()], [[0.0, 0.0], [0.6, 0.8]])


# ---- PCA


def test_block_slices():
    assert [(s.start, s.stop) for s in pca.block_slices(10, 3)] == [(0, 4), (4, 7), (7, 10)]
    with pytest.raises(ValueError):
        pca.block_slices(0, 1)


@pytest.mark.parametrize("standardise", [True, False])
def test_pca_equals_numpy(spark, standardise):
    x = np.random.default_rng(8).normal(size=(60, 10)) * np.arange(1, 11)
    x[:, 3] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, fde array<double>").repartition(5)
    model = pca.fit(rows, 3, keep=6, standardise=standardise)
    y = (x - x.mean(0)) / (x.std(0) + 1e-12) if standardise else x
    found = []
    for b, s in enumerate(pca.block_slices(10, 3)):
        value, vector = np.linalg.eigh(np.cov(y[:, s].T))
        found += [(v, b, vector[:, j], s) for j, v in enumerate(value)]
    found.sort(key=lambda t: -t[0])
    assert np.allclose(model.eigenvalues, [f[0] for f in found[:6]])
    for j, (_, _, vector, s) in enumerate(found[:6]):
        own = model.weights[s, j]
        assert abs(abs(own @ vector) - 1) < 1e-6 and np.count_nonzero(np.delete(model.weights[:, j], np.r_[s])) == 0
    out = np.array([r.vec for r in pca.transform(rows, model).orderBy("id").collect()])
    assert np.allclose(out, x @ model.weights)
    out = np.array([r.vec for r in pca.transform(rows, model, standardised=True).orderBy("id").collect()])
    assert np.allclose(out, (x - x.mean(0)) / (x.std(0) + 1e-12) @ model.weights)
    with pytest.raises(ValueError):
        model.transform(x[:, :4])
    with pytest.raises(Exception, match="4 samples|samples for"):
        pca.fit(rows.limit(4), 1)
    assert pca.fit(rows, 2, sample_rate=0.5, seed=1).weights.shape == (10, 10)


# ---- search


def test_search_exact_and_small(spark):
    draw = np.random.default_rng(5)
    q, d = draw.normal(size=(7, 6)), draw.normal(size=(40, 6))
    d[11] = d[3]
    qf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "did long, vec array<double>").repartition(4)
    scores = q @ d.T
    for k in (1, 5, 100):
        want = {(i, r + 1): j for i in range(7) for r, j in enumerate(sorted(range(40), key=lambda j: (-scores[i, j], j))[:k])}
        for got in (search.exact(qf, df, k), search.exact_sql(qf, df, k)):
            assert {(r.qid, r.rank): r.did for r in got.collect()} == want
    assert search.exact(qf.limit(0), df, 3).count() == 0 and search.exact(qf, df.limit(0), 3).count() == 0
    text = df.withColumn("did", F.concat(F.lit("d"), "did"))
    assert search.exact(qf, text, 2).dtypes[1] == ("did", "string")


def test_sample_is_of_the_least_hashes(spark):
    many = spark.range(5000).repartition(3)
    least = [r.id for r in many.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(1234).collect()]
    assert sorted(r.id for r in tk.sample_ids(many, 1234 / 5000 + 1e-9, 7).collect()) == sorted(least)
    assert tk.sample_ids(many, 1.0, 7).count() == 5000


def test_search_in_several_blocks(spark, monkeypatch):
    draw = np.random.default_rng(12)
    q, d = draw.normal(size=(9, 6)), draw.normal(size=(40, 6))
    qf = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, vec array<double>")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(d)], "did long, vec array<double>").repartition(3)
    key = lambda rows: sorted((r.qid, r.did, r.rank, round(r.score, 9)) for r in rows.collect())
    whole, cells = key(search.exact(qf, df, 5)), key(search.CellIndex(df, 4).search(qf, 5, 2))
    monkeypatch.setattr(blockjoin, "SCORE_BYTES", 100)
    monkeypatch.setattr(blockjoin, "CELL_BYTES", 200)
    monkeypatch.setattr(blockjoin, "MERGED", 3)
    monkeypatch.setattr(search, "LOT_ROWS", 3)
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "ARRAY_ROWS", 4)
    assert key(search.exact(qf, df, 5)) == whole and key(search.CellIndex(df, 4).search(qf, 5, 2)) == cells
    assert key(search.exact_sql(qf, df, 5)) == whole


def test_arrays_as_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "STEP_NUMBERS", 16)
    draw = np.random.default_rng(3)
    bags = [draw.normal(size=(n, 4)).astype(np.float32) for n in (3, 0, 5, 1, 2)]
    np.save(tmp_path / "points.npy", np.concatenate(bags))
    np.save(tmp_path / "offsets.npy", np.cumsum([0, *map(len, bags)]))
    out = {r.id: r.vecs for r in arrays.load_packed(spark, str(tmp_path / "points.npy"), str(tmp_path / "offsets.npy"), 4).collect()}
    assert out == {i: b.tolist() for i, b in enumerate(bags)}
    rows = {r.id: r.sv for r in arrays.load_matrix(spark, str(tmp_path / "points.npy")).collect()}
    assert rows == dict(enumerate(np.concatenate(bags).tolist()))
    with pytest.raises(ValueError):
        arrays.load_packed(spark, str(tmp_path / "points.npy"), str(tmp_path / "offsets.npy"), 5)


def test_scratch_tables_stay_while_they_are_read(spark):
    import gc

    from bagfold import runtime

    one, two = (runtime.materialize(spark.range(n), "kept") for n in (10, 20))
    derived = one.filter("id > 4").withColumnRenamed("id", "x")
    paths = [f.inputFiles()[0] for f in (one, two)]
    del one, two
    gc.collect()
    exists = lambda: [os.path.exists(p.removeprefix("file://")) for p in paths]
    for _ in range(5):  # the JVM may hold the last plans a little longer
        assert spark.range(9).filter("id > 3").count() == 5
        runtime.drop_unread(spark)
    assert derived.count() == 5 and exists() == [True, False]


def test_cell_index_finds_most(spark):
    draw = np.random.default_rng(6)
    d = draw.normal(size=(400, 8)) + 3 * draw.normal(size=(10, 8))[draw.integers(0, 10, 400)]
    q = d[:30] + 0.1 * draw.normal(size=(30, 8))
    qf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "did long, vec array<double>").repartition(4)
    exact = search.exact(qf, df, 10)
    index = search.CellIndex(df, 10)
    assert search.overlap(index.search(qf, 10, 10), exact) == 1.0
    assert search.overlap(index.search(qf, 10, 5), exact) > 0.9
    assert index.search(qf, 1000, 10).count() == 30 * 400


def test_run_construction_drops_self_hits_without_refill(spark):
    hits = spark.createDataFrame([("a", "a", 1, 9.0), ("a", "b", 2, 8.0), ("a", "c", 3, 7.0), ("b", "c", 1, 1.0)], "qid string, did string, rank int, score double")
    assert sorted((r.qid, r.did, r.score) for r in search.construct_run(hits).collect()) == [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0)]


# ---- metrics


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q1", "d3", 5.0), ("q1", "d1", 4.0), ("q1", "q1", 3.5), ("q1", "d9", 3.0), ("q1", "d2", 2.0), ("q2", "d1", 1.0), ("q4", "d1", 1.0)], "qid string, did string, score double")
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 1), ("q1", "d5", 1), ("q1", "d3", 0), ("q2", "d1", 0), ("q3", "d1", 1)], "qid string, did string, rel int")
    got = {(r.metric, r.k): r.value for r in metrics.evaluate(run, qrels, [1, 4]).collect()}
    ideal = 2 / np.log2(2) + 1 / np.log2(3) + 1 / np.log2(4)
    want = {
        ("recall", 1): 0.0, ("recall", 4): (2 / 3 + 0) / 2, ("p", 4): (2 / 4 + 0) / 2, ("map", 4): ((1 / 2 + 2 / 4) / 3 + 0) / 2,
        ("ndcg", 4): ((2 / np.log2(3) + 1 / np.log2(5)) / ideal + 0) / 2, ("mrr", 1): 0.0, ("mrr", 4): (1 / 2) / 3, ("r_cap", 4): (2 / 3) / 3, ("hole", 4): (1 / 4) / 3, ("accuracy", 4): 1 / 3, ("accuracy", 1): 0.0,
    }
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-5), key
    one = {r.k: r.value for r in metrics.evaluate_one(run, qrels, [4], "MRR@k").collect()}
    assert one == {4: got["mrr", 4]}
    with pytest.raises(ValueError):
        metrics.evaluate_one(run, qrels, [4], "unknown")
    assert metrics.evaluate(run.limit(0), qrels, [3]).count() == 0


# ---- fusion


def test_positives_and_negatives(spark):
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 0), ("q", "z", 1), ("r", "a", 1)], "qid string, did string, rel int")
    queries, docs = spark.createDataFrame([("q",), ("s",)], "qid string"), spark.createDataFrame([(x,) for x in "abcdefgh"], "did string")
    found = fusion.positives(qrels, queries, docs)
    assert [tuple(r) for r in found.collect()] == [("q", "a")]
    with pytest.raises(ValueError):
        fusion.positives(qrels.filter("rel < 0"), queries, docs)
    with pytest.raises(ValueError):
        fusion.sampled_negatives(found, docs.filter("did = 'a'"), None, 3, 1)
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("s", "b", 1)], "qid string, did string, rank int")
    hard = fusion.hard_negatives(hits, found)
    assert sorted(r.did for r in hard.collect()) == ["b", "c"]
    out = {r.did for r in fusion.sampled_negatives(found, docs, hard, 5, 1).collect()}
    assert "a" not in out and {"b", "c"} <= out and len(out) <= 5
    assert fusion.hard_top_k(10, 50) == 50 and fusion.hard_top_k(10, 10_000) == 500 and fusion.hard_top_k(1, 10_000) == 100


@pytest.mark.parametrize("model", [fusion.TwoScales(), fusion.PerDimension(np.random.default_rng(1).normal(size=7) / 3, 4), fusion.QueryAdaptive.seeded(5, 3)])
def test_gradients_equal_differences(model):
    x = np.random.default_rng(2).normal(size=(9, 7 if isinstance(model, fusion.PerDimension) else 6))

    def loss(raw):
        kept, model.raw = model.raw, raw
        out = model.gradient(x)[1] / len(x) + model.pulled()[1]
        model.raw = kept
        return out

    got = model.gradient(x)[0] / len(x) + model.pulled()[0]
    for j in range(len(model.raw)):
        step = np.zeros(len(model.raw))
        step[j] = 1e-6
        assert got[j] == pytest.approx((loss(model.raw + step) - loss(model.raw - step)) / 2e-6, abs=1e-6)


def test_training_lowers_the_loss(spark):
    draw = np.random.default_rng(4)
    docs = [(f"d{i}", draw.normal(size=4).tolist(), draw.normal(size=3).tolist()) for i in range(30)]
    # only part b tells which document is right
    queries = [(f"q{i}", draw.normal(size=4).tolist(), docs[i][2]) for i in range(10)]
    q, d = spark.createDataFrame(queries, "qid string, vec array<double>, sv array<double>"), spark.createDataFrame(docs, "did string, vec array<double>, sv array<double>")
    found = spark.createDataFrame([(f"q{i}", f"d{i}") for i in range(10)], "qid string, did string")
    rows = fusion.triples(found, fusion.sampled_negatives(found, d.select("did"), None, 6, 1), q, d, normalise_parts=True)
    two = fusion.TwoScales()
    assert np.allclose(two.scales(), 1)
    losses = fusion.train(two, rows, epochs=8, rate=0.1)
    assert losses[-1] < losses[0] and two.scales()[1] > 1
    each = fusion.PerDimension.ones(4, 3)
    assert fusion.train(each, rows, epochs=6, batches=2, rate=0.2)[-1] < np.log(2) + 0.2 and each.mean_scales()[1] > 1
    adaptive = fusion.QueryAdaptive.seeded(8)
    losses = fusion.train(adaptive, rows, epochs=8, rate=0.05)
    assert losses[-1] < losses[0]
    left, right = fusion.apply_adaptive(q, d, adaptive)
    assert len(left.first().vec) == 7 == len(right.first().vec)


def test_concat_and_scales(spark):
    a = spark.createDataFrame([(1, [3.0, 4.0])], "id long, vec array<double>")
    b = spark.createDataFrame([(1, [0.0, 2.0])], "id long, sv array<double>")
    assert np.allclose(fusion.concat(a, b).first().vec, np.array([0.6, 0.8, 0, 1]) / np.sqrt(2))
    assert fusion.concat(a, b, normalise_parts=False, normalise_all=False).first().vec == [3.0, 4.0, 0.0, 2.0]
    assert fusion.scaled_concat(a, b, 2.0, [1.0, 0.5], normalise_parts=False, normalise_all=False).first().vec == [6.0, 8.0, 0.0, 1.0]


# ---- plans and streaming


@pytest.fixture(scope="module")
def collection(spark):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(60, 16))
    docs = [(f"d{i}", (centres[i] + 0.2 * draw.normal(size=(6, 16))).astype(np.float32)) for i in range(60)]
    queries = [(f"q{i}", (centres[i] + 0.2 * draw.normal(size=(3, 16))).astype(np.float32)) for i in range(0, 60, 4)]
    single = lambda items: spark.createDataFrame([(i, m.mean(0).tolist()) for i, m in items], "id string, sv array<float>")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(0, 60, 4)], "qid string, did string, rel int")
    return tk.from_arrays(spark, docs, "string"), tk.from_arrays(spark, queries, "string"), single(docs), single(queries), qrels


SETTINGS = RetrievalSettings(0.5, 8, 2, 4, 30, 0.8, 10)


def test_hybrid_plan_equals_numpy_and_finds(spark, collection):
    corpus, queries, d_sv, q_sv, qrels = collection
    built = retrieval.offline(corpus, 16, SETTINGS, hybrid=True)
    assert len(built.reps) == 4
    x = {r.id: np.array(r.fde) for r in enc.encode(corpus, built.config, built.reps).collect()}
    for r in built.documents.collect():
        assert np.allclose(r.vec, x[r.did] @ built.model.weights / (np.linalg.norm(x[r.did]) + 1e-12))
    run = retrieval.online(built, queries, 10, d_sv, q_sv)
    value = {r.metric: r.value for r in metrics.evaluate(run, qrels, [10]).collect()}
    assert value["recall"] > 0.9
    with pytest.raises(ValueError):
        retrieval.online(built, queries, 10)
    model, losses = retrieval.fit_fusion(built, queries, qrels, d_sv, q_sv, top_k=2, negatives=8, epochs=4)
    # each epoch has negatives of its own, so the model before and after is compared on the same pairs
    sides = retrieval.query_vectors(built, queries).join(q_sv.withColumnRenamed("id", "qid"), "qid"), built.documents.join(d_sv.withColumnRenamed("id", "did"), "did")
    found = qrels.select("qid", "did")
    others = found.select("qid").crossJoin(built.documents.select("did")).join(found, ["qid", "did"], "left_anti")
    x = np.array([r.x for r in fusion.product_features(fusion.triples(found, others, *sides, normalise_parts=False)).collect()])
    before = fusion.PerDimension.ones(model.size_a, len(model.raw) - model.size_a)
    assert len(losses) == 4 and len(x) == 15 * 59 and model.gradient(x)[1] <= before.gradient(x)[1]
    run = retrieval.online(built, queries, 10, d_sv, q_sv, fused=model)
    assert {r.metric: r.value for r in metrics.evaluate(run, qrels, [10]).collect()}["recall"] > 0.9
    run = retrieval.online(built, queries, 10, d_sv, q_sv, cells=6, probes=6)
    assert run.count() == 150


def test_multi_vector_plan(spark, collection, tmp_path):
    corpus, queries, *_, qrels = collection
    built = retrieval.offline(corpus, 16, SETTINGS, hybrid=False)
    x = {r.id: np.array(r.fde) for r in enc.encode(corpus, built.config, built.reps).collect()}
    every = np.array([x[i] for i in sorted(x)])
    want = (every - every.mean(0)) / (every.std(0) + 1e-12) @ built.model.weights
    got = {r.did: np.array(r.vec) for r in built.documents.collect()}
    assert np.allclose([got[i] for i in sorted(x)], want, atol=1e-8)
    asked = {r.id: np.array(r.fde) @ built.model.weights for r in enc.encode(queries, built.config.for_queries(), built.reps, kind="query").collect()}
    plan = {(q, d): 5.0 - n for q, v in asked.items() for n, d in enumerate(sorted(sorted(x), key=lambda d: -(v @ got[d]))[:5])}
    assert {(r.qid, r.did): r.score for r in retrieval.online(built, queries, 5).collect()} == plan and len(plan) == 75
    # along a graph that is built once and then loaded
    runs = [sorted((r.qid, r.did, r.score) for r in retrieval.online(built, queries, 5, index=f"{tmp_path}/graph").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len({(q, d) for q, d, _ in runs[0]} & set(plan)) >= 68
    with pytest.raises(ValueError):
        retrieval.offline(corpus, 16, RetrievalSettings(0.5, 8, 5, 8, 30, 0.5))


def test_streamed_documents_equal_the_index(spark, collection, tmp_path):
    from bagfold.streaming.encode import write_index

    corpus, *_ = collection
    built = retrieval.offline(corpus, 16, SETTINGS, hybrid=True)
    corpus.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(corpus.schema).parquet(f"{tmp_path}/in")
    query = write_index(stream, built, f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    got = {r.id: r.vec for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 60 and all(np.allclose(got[r.did], r.vec) for r in built.documents.collect())


def test_command_line(spark, collection, tmp_path):
    from bagfold import cli

    corpus, queries, d_sv, q_sv, qrels = collection
    base = tmp_path / "c" / "toy"
    (base / "qrels").mkdir(parents=True)
    for split in ("test", "train"):
        (base / "qrels" / f"{split}.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{r.qid}\t{r.did}\t{r.rel}\n" for r in qrels.collect()))
    for name, frame in (("corpus_mv", corpus), ("query_mv", queries), ("query_train_mv", queries)):
        frame.write.parquet(f"{tmp_path}/v/toy/mv/{name}")
    for name, frame in (("corpus_sv", d_sv), ("query_sv", q_sv), ("query_train_sv", q_sv)):
        frame.write.parquet(f"{tmp_path}/v/toy/sv/{name}")
    given = ["--dataset", "toy", "--collections", f"{tmp_path}/c", "--vectors", f"{tmp_path}/v", "--choose-rate", "0.5", "--repetitions", "6", "--bits", "2", "--projection-dimension", "4", "--keep-dimensions", "20", "--sampling-rate", "0.8"]
    out = cli.main([*given, "--train-fusion", "--fusion-epochs", "2", "--fusion-negatives", "4"], spark)
    assert out["metrics"]["recall@10"] > 0.8 and set(out["seconds"]) == {"offline", "fusion", "online"}
    assert cli.main([*given, "--no-hybrid", "--cells", "5"], spark)["metrics"]["recall@10"] > 0.5

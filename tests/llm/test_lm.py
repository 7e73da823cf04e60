"""Scores by unigrams against a plain version; the attention model by gradients, sums and held-out texts."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bagfold.llm import lm
from bagfold.llm.attention import Adam, Shape, Vocabulary, flatten, gradient, log_likelihood, start, unflatten, windows
from bagfold.llm.packing import encoder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TINY = Shape(slots=12, shared=4, width=4, window=6, overlap=2, classes=7, pooled=3)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_base(rows):
    out = [(zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, WORD.findall(lower(t))) for i, t in rows]
    count = Counter(w for held, words in out if not held for w in words)
    ends = sum(not held for held, _ in out)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return [(i, held, len(words) + 1, sum(count[w] > 0 for w in words) + (ends > 0), n, sum(log(count[w]) for w in words) + log(ends)) for (i, _), (held, words) in zip(rows, out, strict=True)]


def rounded(rows):
    return sorted(((*r[:5], round(r[5], 6) + 0.0) for r in rows), key=str)


def scored(frame):
    return rounded([tuple(r)[:6] for r in frame.collect()])


@pytest.mark.parametrize("listed", [0, 30, 1 << 17])
def test_base_scores_equal_plain(spark, odd_docs, listed):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    clash = odd_docs.withColumn("rid", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("held_out", F.lit(True)).withColumn("score", F.lit(0.0))
    out = lm.score(clash, PATH, PATTERN, listed=listed)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert scored(out) == rounded(plain_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out.collect())


def test_only_held_out_and_no_documents(spark, no_docs, tables):
    held = next(i for i in itertools.count() if zlib.crc32(str(i).encode()) % 7 == 2)
    out = lm.score(spark.createDataFrame([(held, "Two words"), (held, None)], "doc_id long, text string"), PATH, PATTERN)
    assert scored(out) == rounded(plain_base([(held, "Two words"), (held, None)]))
    assert lm.op12_attention_scores(spark, tables(documents=no_docs)).collect() == []


def plain_score(text, model, voc, encode, shape):
    """By one place after another, each from the ids of its own window."""
    ids = [int(i) for i in encode(lower(text), disallowed_special=())] + [voc.end]
    before = [voc.end, *ids[:-1]]
    total, done, n = 0.0, 0, len(ids)
    step = shape.window - shape.overlap
    first = 0
    while done < n:
        lo = min(first, max(n - shape.window, 0))
        x = model["rows"][voc.slot[before[lo : lo + shape.window]]].astype(float) + model["places"][: min(shape.window, n - lo)]
        for j in range(done, min(lo + shape.window, n)):
            at = j - lo
            q, k, v = x[at] @ model["query"], x[: at + 1] @ model["key"], x[: at + 1] @ model["value"]
            a = np.exp(k @ q / np.sqrt(shape.width))
            h = x[at] + (a @ v / a.sum()) @ model["mix"]
            z = h @ model["out"] + model["bias"]
            total += (z[voc.cls[ids[j]]] - np.log(np.exp(z).sum())) / np.log(10) + voc.share[ids[j]]
        done, first = min(lo + shape.window, n), first + step
    return total


def test_scores_are_sums_over_all_places(spark, docs):
    """The operator's windows and batches against one place after another, with a model that has been trained."""
    texts, _, _, _, _ = lm.encoded(docs, PATH, PATTERN)
    voc = Vocabulary(lm.id_counts(texts, 50257), lm.SHAPE)
    model = lm.train(texts, voc)
    cast = spark.sparkContext.broadcast
    got = {r.doc_id: r.score for r in texts.mapInArrow(lm._scores(cast(model), cast(voc), lm.SHAPE), lm.TEXTS.replace("ids binary", "score double")).collect()}
    encode, now = encoder(PATH, PATTERN), unflatten(model, lm.SHAPE)
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == pytest.approx(plain_score(r.text, now, voc, encode, lm.SHAPE), rel=2e-4, abs=1e-3)
    assert np.abs(now["out"]).max() > 0  # steps were taken


def test_id_counts_equal_plain(spark, docs):
    texts, _, _, _, _ = lm.encoded(docs, PATH, PATTERN)
    encode, want = encoder(PATH, PATTERN), np.zeros(50257, int)
    for r in docs.select("doc_id", "text").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            np.add.at(want, encode(lower(r.text), disallowed_special=()).astype(int), 1)
            want[-1] += 1
    assert (lm.id_counts(texts, 50257) == want).all()


def test_gradient_by_differences():
    draw = np.random.default_rng(0)
    voc = Vocabulary(np.arange(14), TINY)
    model = {k: x.astype(float) for k, x in start(TINY, voc).items()}
    model["out"] = draw.normal(size=model["out"].shape)
    slots, classes, scored = draw.integers(0, 12, (3, 6)), draw.integers(0, 7, (3, 6)), draw.random((3, 6)) > 0.3
    loss, grad = gradient(model, slots, classes, scored, TINY)
    assert loss == pytest.approx(-log_likelihood(model, slots, classes, scored, TINY).mean())
    for name, g in grad.items():
        for at in itertools.islice(np.ndindex(g.shape), 0, None, 5):
            old, ends = model[name][at], []
            for d in (1e-5, -1e-5):
                model[name][at] = old + d
                ends.append(gradient(model, slots, classes, scored, TINY)[0])
            model[name][at] = old
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_probabilities_sum_to_one_and_start_as_unigrams():
    counts = np.array([5, 0, 100, 3, 3, 1, 40, 2, 0, 0, 7, 1, 9, 20])
    voc = Vocabulary(counts, TINY)
    model = start(TINY, voc)
    slots = np.arange(6)[None] % 12
    total = np.zeros(6)
    for i in range(len(counts)):
        p = np.exp(log_likelihood(model, slots, np.full((1, 6), voc.cls[i]), np.ones((1, 6), bool), TINY)) * 10 ** voc.share[i]
        assert p == pytest.approx((counts[i] + 1) / (counts.sum() + len(counts)), rel=1e-5)
        total += p
    assert total == pytest.approx(1)
    assert sorted(flatten(unflatten(flatten(model), TINY))) == sorted(flatten(model))


@pytest.mark.parametrize("overlap", [0, 2, 5])
def test_windows_score_each_place_once(overlap):
    lengths = np.array([0, 1, 5, 6, 7, 10, 11, 40, 6])
    doc, first, skip, size = windows(lengths, TINY, overlap)
    seen = [(d, p) for d, f, s, n in zip(doc, first, skip, size, strict=True) for p in range(f + s, f + n)]
    assert sorted(seen) == [(d, p) for d, n in enumerate(lengths) for p in range(n)]
    assert all(s >= overlap for f, s in zip(first, skip, strict=True) if f) and all(n == min(6, lengths[d]) for d, n in zip(doc, size, strict=True))


def test_held_out_texts_gain_from_their_context(spark):
    """Each text is in one of four invented languages; what stands before tells which, so the model beats unigrams of ids on texts it never saw."""
    draw = random.Random(8)
    words = [[f"{a}{b}{c}" for b in "aeiou" for c in "kmt"] for a in ("br", "zw", "ql", "vn")]
    rows = [(i, " ".join(draw.choice(words[i % 4]) for _ in range(draw.randint(150, 400)))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts, _, _, _, _ = lm.encoded(docs, PATH, PATTERN)
    counts = lm.id_counts(texts, 50257)
    logs = np.log10((counts + 1) / (counts.sum() + len(counts)))
    encode = encoder(PATH, PATTERN)
    own = {i: logs[encode(t, disallowed_special=()).astype(int)].sum() + logs[-1] for i, t in rows}
    held = [r for r in lm.score(docs, PATH, PATTERN).collect() if r.held_out]
    assert len(held) > 100 and sum(r.score for r in held) > 0.9 * sum(own[r.doc_id] for r in held)
    better = sum(r.score > own[r.doc_id] for r in held)
    assert better >= 0.95 * len(held)


def test_training_step_lowers_the_loss():
    draw = np.random.default_rng(1)
    voc = Vocabulary(np.arange(14), TINY)
    model = start(TINY, voc)
    slots = draw.integers(0, 12, (40, 6))
    classes = (slots * 3 + 1) % 7
    scored, adam, losses = np.ones((40, 6), bool), Adam(model, 0.05), []
    for _ in range(60):
        loss, grad = gradient(model, slots, classes, scored, TINY)
        adam.step(model, grad)
        losses.append(loss)
    assert losses[-1] < 0.3 * losses[0]


def test_long_text(spark):
    text = "Ünique words " * 40_000
    out = lm.score(spark.createDataFrame([(1, text), (2, "x" * 30_000)], "doc_id long, text string"), PATH, PATTERN)
    assert scored(out) == rounded(plain_base([(1, text), (2, "x" * 30_000)]))


def test_every_id_of_a_training_text_is_in_a_step(spark):
    """The weights of the tasks' models add up to all ids and ends."""
    from types import SimpleNamespace

    import pyarrow as pa

    voc = Vocabulary(np.ones(300, np.int64), lm.SHAPE)
    model = flatten(start(lm.SHAPE, voc))
    sizes = [0, 1, 31, 32, 33, 64, 1000, 70_000]
    ids = [np.arange(n).astype("<u2") % 299 for n in sizes]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["rid", "ids"])
    out = list(lm._trained(SimpleNamespace(value=model), SimpleNamespace(value=voc), lm.SHAPE, 0.01)(iter([rows])))
    assert out[0].column(1)[0].as_py() == sum(n + 1 for n in sizes)


def test_a_step_takes_little_new_memory():
    """Arrays of the size of a step are used again."""
    draw = np.random.default_rng(2)
    voc = Vocabulary(np.ones(300, np.int64), lm.SHAPE)
    model = start(lm.SHAPE, voc)
    slots, classes = draw.integers(0, 4096, (128, 32)).astype(np.int32), draw.integers(0, 64, (128, 32))
    gradient(model, slots, classes, np.ones((128, 32), bool), lm.SHAPE)
    tracemalloc.start()
    try:
        gradient(model, slots, classes, np.ones((128, 32), bool), lm.SHAPE)
        assert tracemalloc.get_traced_memory()[1] < 2.5e6
    finally:
        tracemalloc.stop()


def test_likelihood_without_the_first_places_is_the_same():
    draw = np.random.default_rng(3)
    voc = Vocabulary(np.arange(14), TINY)
    model = {k: draw.normal(size=x.shape) for k, x in start(TINY, voc).items()}
    slots, classes = draw.integers(0, 12, (5, 6)), draw.integers(0, 7, (5, 6))
    late = np.ones((5, 6), bool)
    late[:, :2] = False
    whole = log_likelihood(model, slots, classes, np.ones((5, 6), bool), TINY).reshape(5, 6)
    assert log_likelihood(model, slots, classes, late, TINY) == pytest.approx(whole[:, 2:].ravel())


def test_hashed_chunks_give_the_ids_of_whole_texts():
    from bagfold.llm.chunks import HashedMemo
    from bagfold.llm.packing import vocabulary

    draw, encode, calls = random.Random(3), encoder(PATH, PATTERN), []
    tokens = vocabulary(PATH)[0]
    sizes = np.zeros(1 + max(tokens.values()), np.int32)
    sizes[list(tokens.values())] = [len(x) for x in tokens]
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "a", "é", "ш", "日", "'s", "1", "!", "<|endoftext|>", "\U0001f44d", "\r\n", "foo", "\u200b"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + ["", " ", "x" * 3000, " " * 500 + "a", " a b ", "a  "]

    def counted(text):
        calls.append(text)
        return encode(text, disallowed_special=())

    memo = HashedMemo(counted, sizes)
    for some in (texts, texts[:50], ["a b c d"] * 500, [""], []):
        raw = [t.encode() for t in some]
        before = len(calls)
        got = memo.texts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64))
        assert got.to_pylist() == [encode(t, disallowed_special=()).astype("<u2").tobytes() for t in some]
        assert some is texts or len(calls) <= before + 2  # new chunks are encoded together


def test_packed_keys_are_counted_by_row():
    import pyarrow as pa

    from bagfold.llm.tally import _each

    rows = [(7, [3, 1, 3]), (8, []), (9, [1]), (7, [3, 3])]
    batch = pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows]), pa.array([np.array(k, np.int64).tobytes() for _, k in rows], pa.binary())], names=["rid", "rest"])
    out = list(_each(iter([batch])))
    assert len(out) == 1  # one batch, not one a row
    assert sorted(zip(*(c.to_pylist() for c in out[0].columns), strict=True)) == [(7, 1, 1), (7, 3, 2), (7, 3, 2), (9, 1, 1)]


def test_places_with_weight_zero_change_nothing():
    """A step over nearly all places equals the mean of what each place says alone."""
    draw = np.random.default_rng(5)
    voc = Vocabulary(np.arange(14), TINY)
    model = {k: draw.normal(size=x.shape) for k, x in start(TINY, voc).items()}
    slots, classes = draw.integers(0, 12, (3, 6)), draw.integers(0, 7, (3, 6))
    for left_out in ([4], [4, 9, 17], list(range(3, 15))):
        scored = np.ones((3, 6), bool)
        scored.ravel()[left_out] = False
        parts = []
        for at in np.flatnonzero(scored):
            one = np.zeros((3, 6), bool)
            one.ravel()[at] = True
            parts.append(gradient(model, slots, classes, one, TINY))
        loss, grad = gradient(model, slots, classes, scored, TINY)
        assert loss == pytest.approx(np.mean([x for x, _ in parts]))
        same = gradient(model, slots, classes, scored, TINY, with_loss=False)
        assert same[0] == 0
        for k in grad:
            assert grad[k] == pytest.approx(np.mean([g[k] for _, g in parts], axis=0), abs=1e-12)
            assert (same[1][k] == grad[k]).all()


def test_a_step_is_that_of_adam():
    draw = np.random.default_rng(6)
    model = start(TINY, Vocabulary(np.arange(14), TINY))
    want = {k: x.astype(float) for k, x in model.items()}
    m, v = ({k: np.zeros_like(x) for k, x in want.items()} for _ in range(2))
    adam = Adam(model, 0.01)
    assert len(adam.m) == sum(x.size for x in model.values()) and all(np.shares_memory(x, adam.flat) for x in model.values())  # one pass for all arrays
    for t in range(1, 30):
        grad = {k: draw.normal(size=x.shape).astype(np.float32) for k, x in model.items()}
        adam.step(model, grad)
        for k, g in grad.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            want[k] -= 0.01 * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    assert all(model[k] == pytest.approx(x, abs=1e-5) for k, x in want.items())


def test_words_of_a_chunk_are_looked_up_once(monkeypatch):
    """Words, listed words, their sum and the other words' hashes come with the chunks that a task remembers."""
    from types import SimpleNamespace

    import pyarrow as pa
    from bagfold.llm.packing import vocabulary

    draw, tokens = random.Random(4), vocabulary(PATH)[0]
    sizes = np.zeros(1 + max(tokens.values()), np.int32)
    sizes[list(tokens.values())] = [len(x) for x in tokens]
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "B", "É", "the", "one two", "x\ny", "\x0bz", "日本"]
    texts = [None, "", " ", "\n\n"] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(500)]
    def hashes(words):
        raw = [w.encode() for w in words]
        return lm._word_hashes(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, len(b" ".join(raw))]))[1]

    looked, find = [], lm.find
    monkeypatch.setattr(lm, "find", lambda keys, h: looked.append(len(h)) or find(keys, h))
    for listed in (["the", "a", "é", "two"], []):
        keys = np.sort(hashes(listed)) if listed else np.zeros(0, np.int64)
        counts = np.arange(len(listed)) + 1
        run = lm._encoded(PATH, PATTERN, SimpleNamespace(value=(keys, counts)), True, SimpleNamespace(value=sizes))
        n = len(texts)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(texts, pa.string())], names=["rid", "doc_id", "held_out", "text"])
        looked.clear()
        first, again = run(iter([batch, batch]))
        assert len(looked) == 1 and first.equals(again)
        logs = dict(zip(keys.tolist(), np.log10(counts + 1.0), strict=True))
        for t, r in zip(texts, first.to_pylist(), strict=True):
            h = hashes([w for w in lower(t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]).tolist()
            assert r["n_tokens"] == len(h) + 1 and r["n_known"] == 1 + sum(x in logs for x in h)
            assert r["listed"] == pytest.approx(sum(logs.get(x, 0) for x in h))
            assert np.frombuffer(r["rest"], np.int64).tolist() == [x for x in h if x not in logs]

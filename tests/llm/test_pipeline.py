"""The pipeline against the plain versions of its stages."""

import public_tokenizers
from test_brute import plain_spans, plain_verdicts
from test_operators import check_packing

import corpus_pipeline
from bagfold.llm import disclosure, fertility, lines, ngram_join


def plain_lines(rows, least=10):
    first = {}
    key = lambda x: lines.line_key(x.encode(), least)
    for i, t in sorted(rows):
        for x in t.split("\n"):
            if (k := key(x)) is not None:
                first.setdefault(k, i)
    return [(i, "\n".join(x for x in t.split("\n") if (k := key(x)) is None or first[k] == i)) for i, t in rows]


def test_stages_one_after_another(spark, docs, tables):
    folder = tables(documents=docs.select("doc_id", "text", "lang", "source", "n_chars"))
    read = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "personal_data", "packing"]
    now = read
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, folder)
        assert out.columns == read.columns
        got = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "quality":
            kept = plain_verdicts(fertility.verdicts(fertility.measures(now, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])).collect())
            want = [r for r in before if kept[(r[0],)]]
        elif name == "line_dedup":
            was = dict(before)
            want = [r for r in plain_lines(before) if r[1].strip() or r[1] == was[r[0]]]
        elif name == "near_copies":
            root = ngram_join.op4_brute(before, 5, 80)
            want = [r for r in before if root[r[0]][1] == r[0]]
        else:
            spans = plain_spans([t for _, t in before])
            want = [(i, disclosure.masked(t, spans[t])) for i, t in before]
        assert got == sorted(want), name
        out.write.parquet(f"{folder}/stage{k}.parquet")
        now = spark.read.parquet(f"{folder}/stage{k}.parquet")
        assert all(r.n_chars == len(r.text) for r in now.collect() if r.text is not None and name != "quality")
    texts = {r.doc_id: r.text for r in now.collect()}
    check_packing(corpus_pipeline.run(spark, folder), texts)


def test_two_runs_at_once(spark, docs, tables):
    """A second run, or a stage of it, leaves the first one's result readable."""
    folder = tables(documents=docs.select("doc_id", "text", "lang", "source", "n_chars"))
    read = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.line_dedup(spark, read.filter("text is not null"), folder)
    two = corpus_pipeline.quality(spark, read, folder).select("doc_id")
    packed = corpus_pipeline.packed(spark, read, folder)
    counts = [f.count() for f in (packed, two, one)]
    corpus_pipeline.line_dedup(spark, read.limit(3), folder).count()
    assert [f.count() for f in (packed, two, one)] == counts and all(counts)


def test_empty_corpus(spark, no_docs, tables):
    folder = tables(documents=no_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert corpus_pipeline.run(spark, folder).count() == 0

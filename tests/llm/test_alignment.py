"""Alignment of two vocabularies against a plain version with the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bagfold.llm import alignment, tally

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def plain_tokens(text, tools):
    """(A ids and bytes, B ids and bytes); none where bytes differ."""
    t, sp = tools
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    if not text:
        return [], []
    a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode()
    return (a, b) if same else ([], [])


def plain_document(text, tools):
    """Ids, groups and links of one text."""
    a, b = plain_tokens(text, tools)
    ends = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((at, i))
        ends.append(out)
    last = [dict(side) for side in ends]
    both = sorted(last[0].keys() & last[1].keys())
    links = [(last[0][e], last[1][e]) for e in both]
    groups, at = [], [0, 0]
    for e in both:
        cut = [], []
        for s in (0, 1):
            while at[s] < len(ends[s]) and ends[s][at[s]][0] <= e:
                cut[s].append(str(ends[s][at[s]][1]))
                at[s] += 1
        groups.append("|".join(",".join(ids) for ids in cut))
    return len(a), len(b), groups, links


def plain_op13(rows, tools):
    docs = [(i, *plain_document(t or "", tools)) for i, t in rows]
    count = Counter(pair for *_, links in docs for pair in links)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return sorted(
        ((i, a, b, len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, k in docs), key=str
    )


@pytest.fixture(scope="module")
def tools():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True  # the contract: their strings in a text are plain text
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


ODD = [" ", "  ", "\n", " \n a", "a \n b", "a  b ", " a", "x\x1c y \x1d", "a▁b", "a ▁", "ok a▁b c", "<s>hi</s><unk> <|endoftext|>", "\r\n\r\n{\r", "tab\t x \t", "\xa0 　 z", "\x00 \x00", "é ́", "don't we'll  'S", "🙂 🙂🙂 👩‍👩‍👧", "word " * 50, "é" * 3000]


def test_op13_equals_plain(spark, rows, tools, tables):
    docs = [(i, t) for i, t, *_ in rows] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, None), (3, "two"), (3, "two")]
    folder = tables(documents=spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    out = alignment.op13_token_alignment(spark, folder)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(out) == plain_op13(docs, tools)


@pytest.mark.parametrize("listed", [0, 40, 1 << 19])
def test_pairs_beyond_the_list(spark, rows, tools, listed):
    docs = [(i, t) for i, t, *_ in rows]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, rid long, links long, key long").repartition(3)
    links = alignment.aligned(frame, A, PATTERN, B)
    out = alignment.with_counts(links, alignment.pair_counts(links), listed).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert rows_of(out) == plain_op13(docs, tools)


def test_op13_empty_table(spark, no_docs, tables):
    folder = tables(documents=no_docs)
    assert alignment.op13_token_alignment(spark, folder).collect() == []


def test_op13_long_texts_and_small_memory(spark, tools, monkeypatch):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeéßя一") for _ in range(draw.randint(1, 9)))
    docs = [(0, " ".join(word() for _ in range(60_000))), (1, "\n".join(word() for _ in range(500))), (2, "x" * 20_000)]
    aligner = alignment.Aligner(A, PATTERN, B)
    monkeypatch.setattr(alignment, "MEMO_CHARS", 10)
    for i, t in docs:
        facts, sha, links, _ = aligner.documents([t])
        n_a, n_b, groups, pairs = plain_document(t, tools)
        assert facts[:, 0].tolist() == [n_a, n_b, len(groups), len(pairs)] and sha[0] == hashlib.sha256(";".join(groups).encode()).hexdigest()
        assert [(x >> 16, x & 65535) for x in links.tolist()] == pairs


ALIGNER = alignment.Aligner(A, PATTERN, B)
TOOLS = []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x1c\xa0'ab1▁<>_"), st.characters(codec="utf-8")), max_size=40))
def test_chunks_are_aligned_as_whole_texts(text):
    if not TOOLS:
        t = Tokenizer.from_file(A)
        t.encode_special_tokens = True
        TOOLS.extend([t, sentencepiece.SentencePieceProcessor(model_file=B)])
    facts, sha, _, _ = ALIGNER.documents([text])
    n_a, n_b, groups, pairs = plain_document(text, TOOLS)
    assert facts[:, 0].tolist() == [n_a, n_b, len(groups), len(pairs)]
    assert sha[0] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_frequent_keys_are_cut_at_a_class(spark, tmp_path):
    spark.createDataFrame([(i, 1 + i // 10) for i in range(1000)], "key long, n long").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for most in (0, 1, 15, 500, 1000, 5000):
        few, every = tally.frequent(table, most)
        kept = [r.n for r in few.collect()]
        assert len(kept) <= most and every == (most >= 1000)
        assert not kept or sorted(kept) == sorted(1 + i // 10 for i in range(1000))[-len(kept) :]

"""Each operator against a plain version on a small table, and on tables with nulls, repeats and nothing."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bagfold.llm import bpe, components, disclosure, fertility, fingerprint, kernel, keys, lines, ngram_join, packing, registry, rules_index, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def same_as_sql(name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'") if __import__("os").path.isdir(f"{folder}/{t}.parquet") else None
    return con.sql(registry.ORACLES[name])


# ---- op1


def test_base_spans_equal_plain_patterns(rows):
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    texts = [r[1] or "" for r in rows] + ["a@b.c.d@e.f x@y @z.w q@w..e 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111-1111-1111-1111 4111111111111112 +1 2 3 +123456789 (x) +1-2-3-4-5-6-7-8-9-0", "1" * 5000 + "@" * 50 + ".a" * 50]
    for text in texts:
        want = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, text):
                digits = [int(c) for c in m.group() if c in "0123456789"]
                luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits))) % 10 == 0
                if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m.group().split("."))) or (k == 2 and 12 <= len(digits) <= 19 and luhn) or (k == 3 and 9 <= len(digits) <= 15):
                    want.append((m.start(), k, m.end()))
        assert disclosure.base_spans(text) == sorted(want)


def test_disclosing_terms_are_found_and_masked(spark):
    texts = [f"filler{i} words about nothing in particular {i}" for i in range(40)]
    texts += [f"call Zebulon at +49 30 1234567 today number {i}" for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = by_id(disclosure.with_spans(disclosure.personal_data(docs)))
    assert all(found[i].spans == "" for i in range(40))
    for i in range(40, 43):
        spans = [s.split(":") for s in found[i].spans.split(",")]
        terms = {texts[i][int(a) : int(b)]: k for k, a, b in spans}
        assert terms["+49 30 1234567"] == "phone" and terms["Zebulon"] == "remove"
    clean = by_id(disclosure.sanitise(docs))
    assert clean[0].text == texts[0] and clean[0].spans == "en"
    assert "Zebulon" not in clean[41].text and "1234567" not in clean[41].text and "[PHONE]" in clean[41].text
    assert disclosure.masked("abcdef", [(1, 0, 3), (2, 1, 4)]) == "a[EMAIL]ef"


def test_copies_of_a_text_count_once(spark):
    """An exclusive term of two texts with many copies each (some of them repeated rows) is removed."""
    texts = [f"filler{i} words about nothing in particular {i}" for i in range(40)]
    own = [f"mail Zebulon a@example.org number {i}" for i in (1, 2)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, own[i % 2]) for i in range(80)] + [(500, own[0]), (500, own[0]), (None, own[1]), (None, own[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = disclosure.personal_data(docs)
    assert found.count() == len(rows)
    for r in disclosure.with_spans(found).collect():
        assert ("remove:5:12" in r.spans.split(",")) == (r.doc_id is None or r.doc_id >= 100)
    every = disclosure._each_text(docs.select(*disclosure.doc_key(), "text"), found)
    assert sorted(r.text for r in every.collect()) == sorted([*texts, *own])


def test_terms_beside_inner_and_wide_marks(spark):
    """Terms are counted as they are found, whatever marks stand beside them."""
    texts = [f"filler{i} (x/pay/y) words number" for i in range(40)] + [f"<b>Smith</b> Kowalski。 pay a@example.org “Zebulon” user:jdoe number {i}" for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(disclosure.with_spans(disclosure.personal_data(docs)))
    for i in (40, 41):
        terms = {texts[i][int(a) : int(b)]: k for k, a, b in (s.split(":") for s in found[i].spans.split(","))}
        assert all(terms[t] == "remove" for t in ("Smith", "Kowalski", "Zebulon", "jdoe"))
        assert "pay" not in terms and "number" not in terms
    assert all(found[i].spans == "" for i in range(40))


def test_disclosing_terms_anywhere_in_the_document(spark):
    """A heading, a far line and the end of a long line are masked like words beside the entity."""
    words = "this and that was then said by some of them about it all day long"
    texts = [f"{words}\n{words} {words}" for _ in range(40)]
    texts += [f"Zebulon\n{words}\n{words} a@example.org {words} Zebulon\n\n{words}\n" + "- " * i + "by zebulon" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = by_id(disclosure.sanitise(docs))
    assert all(clean[i].text == texts[i] for i in range(40))
    for i in range(40, 43):
        assert clean[i].text == texts[i].replace("Zebulon", "").replace("zebulon", "").replace("a@example.org", "[EMAIL]")


def test_op1_odd_tables(odd_docs, no_docs, rows):
    out = disclosure.with_spans(disclosure.personal_data(odd_docs))
    assert out.count() == odd_docs.count()
    assert disclosure.personal_data(no_docs).count() == 0
    assert disclosure.sanitise(odd_docs).columns == odd_docs.columns and disclosure.sanitise(odd_docs).count() == odd_docs.count()


# ---- op2


def plain_quality(text):
    w = WORD.findall(text)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_op2_counts_and_fertility(docs, rows, odd_docs, no_docs, tables):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = {r.doc.doc_id: r for r in fertility.verdicts(fertility.measures(docs, path, ["doc_id"])).collect()}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, text, *_ in rows:
        m, n = out[i].m, plain_quality(text or "")
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == n
        assert m.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        ids = model.encode(text or "")
        p = np.array(list(Counter(ids).values())) / max(1, len(ids))
        assert m.n_tokens == len(ids) and m.token_entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
        assert m.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / max(1, len(ids)))
    kept = fertility.keep_fit(odd_docs, path)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()
    assert fertility.keep_fit(no_docs, path).count() == 0
    folder = tables(documents=docs.select("doc_id", "text", "lang"))
    assert by_id(registry.QUERIES["op2_tokeniser_fertility"](docs.sparkSession, folder)).keys() == {r[0] for r in rows}


def test_op2_bands_reject_what_is_far_off(spark):
    import random

    draw = random.Random(3)
    words = ["the", "house", "water", "people", "green", "river", "stone", "light", "night", "table", "window", "garden", "morning", "letter", "music", "corner"]
    plain = [" ".join(draw.choice(words) + draw.choice(["", "s", "ed"]) for _ in range(60)) for _ in range(80)]
    odd = "".join(draw.choice("ꙮ𒀀𓀀🜀") + " " for _ in range(60))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, odd])], "doc_id long, text string, lang string")
    out = {r.doc_id for r in fertility.keep_fit(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert set(range(80)) <= out
    # the odd one is alone in its size class, so it has no band; in the class of the others it falls
    more = spark.createDataFrame([(1000, " ".join(["ꙮ𒀀"] * 3 + plain[0].split()[:40]), "en")], "doc_id long, text string, lang string")
    assert 1000 not in {r.doc_id for r in fertility.keep_fit(docs.unionByName(more), public_tokenizers.path("piece_bpe_32k.model")).collect()}


def test_op2_thin_classes_have_a_band(spark):
    """Junk alone in its size class, its language or both is judged by a wider class."""
    import random

    draw = random.Random(3)
    words = ["the", "house", "water", "people", "green", "river", "stone", "light", "night", "table", "window", "garden", "morning", "letter", "music", "corner"]
    plain = lambda n: " ".join(draw.choice(words) + draw.choice(["", "s", "ed"]) for _ in range(n))
    junk = lambda n: "".join(draw.choice("ꙮ𒀀𓀀🜀") + " " for _ in range(n))
    rows = [(i, plain(60), "en") for i in range(80)] + [(100, junk(60), "en"), (101, junk(60), "xx"), (102, junk(3000), "en"), (103, junk(3000), None)]
    rows += [(200, plain(60), "yy"), (201, plain(100), "en"), (202, plain(100), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id for r in fertility.keep_fit(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert out == {*range(80), 200, 201, 202}


# ---- op3

URLS = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/8?q=/de/", "http://example.net/de/81", "http://x.example.net/de/7#a", "http://net/de/", "http://notexample.com/en/7", "http://com?x=/en/", "http://a.org/es", "ftp://a.org/es/1", "no url", None, "", "http://", "http:///en/", "http://example-x.net/de/8", "http://b.com/x://y/en/", "http://a.net/de/8", "https://example.com.net/en/7"]


def test_op3_equals_sql(spark, tables):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, verdict string")
    folder = tables(pages=pages)
    got = sorted(map(tuple, registry.QUERIES["op3_url_rules"](spark, folder).collect()))
    assert got == sorted(same_as_sql("op3_url_rules", folder).fetchall())
    plan = registry.QUERIES["op3_url_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_op3_nested_rules_and_ties(spark):
    rules = [("block", "com", "/"), ("allow", "b.com", "/"), ("block", "a.b.com", "/x"), ("allow", "a.b.com", "/x"), ("allow", "b.com", "/y"), ("block", "b.com", "/y"), ("block", "c.com", ""), ("block", None, "/"), ("allow", "b.com", "/")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("com", "z.com", "b.com", "q.b.com", "a.b.com", "c.com", "bb.com") for p in ("/", "/x", "/y", ""))], "page_id long, url string")
    out = rules_index.judge(pages, rules_index.rule_frame(spark, rules))
    for r in out.collect():
        fits = [(len(h) + len(p), len(h), v == "block", h, p, v) for v, h, p in rules if h and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=None)
        assert (r.rule, r.verdict) == ((best[3] + best[4], best[5]) if best else (None, "allow")), r
    assert rules_index.judge(pages, rules_index.rule_frame(spark, [])).filter("rule is not null or verdict <> 'allow'").count() == 0
    assert rules_index.judge(pages.limit(0), rules_index.rule_frame(spark, rules)).count() == 0


# ---- op4


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_op4_equals_plain_sets(docs, rows, k, percent):
    want = ngram_join.op4_brute([(r[0], r[1]) for r in rows], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.with_component_id(ngram_join.linked_components(docs, k, percent)).collect()}
    assert got == want
    assert any(i != c for i, (_, c) in want.items())


def test_op4_chains_and_shared_passages(spark):
    """Chains of near copies whose ends aren't alike, and one passage in many texts that aren't alike."""
    import random

    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join([f"new{j}" for j in range(i)] + base[i:]) for i in range(0, 60, 2)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join(f"u{i}_{j}" for j in range(12)) + " " + passage for i in range(40)]
    texts += [" ".join(f"v{i}_{j}" for j in range(3)) + " " + passage + f" end{i // 4}" for i in range(40)]
    ids = draw.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    for k, percent in ((4, 85), (2, 60)):
        want = ngram_join.op4_brute(list(zip(ids, texts, strict=True)), k, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.with_component_id(ngram_join.linked_components(docs, k, percent)).collect()}
        assert got == want


def test_op4_odd_tables_and_keep_one(docs, rows, odd_docs, no_docs):
    assert ngram_join.linked_components(no_docs).count() == 0
    out = ngram_join.with_component_id(ngram_join.linked_components(odd_docs))
    assert out.count() == odd_docs.count()
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    group = ngram_join.linked_components(odd_docs).select(F.coalesce("root", F.xxhash64("did", "th"))).distinct().count()
    assert kept.count() == group
    plain = ngram_join.op4_brute([(r[0], r[1]) for r in rows], 5, 80)
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {c for _, c in plain.values()}
    assert ngram_join.keep_one(no_docs).count() == 0


def test_components_of_random_edges(spark):
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 400, 300), draw.integers(0, 400, 300)
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(i, i + 1) for i in range(1000, 1100)], "a long, b long").repartition(5)
    nodes, roots = components.union_find(np.concatenate([a, np.arange(1000, 1100)]), np.concatenate([b, np.arange(1001, 1101)]))
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = {int(n): int(r) for n, r in zip(nodes, roots, strict=True)}
    alone = {n for n in want if n not in got}
    assert got == {n: r for n, r in want.items() if n not in alone} and all(want[n] == n for n in alone)
    assert components.components(edges.limit(0)).count() == 0


# ---- op5


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = bpe.load(path)
    return path, model, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def test_op5_equals_tiktoken(docs, rows, odd_docs, no_docs, multi):
    path, model, own = multi
    out = by_id(bpe.digests(docs, path, public_tokenizers.PATTERN))
    for i, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text or ""))
    back = by_id(bpe.decoded(bpe.encoded(docs, path, public_tokenizers.PATTERN), path))
    assert all(bytes(back[r[0]].bytes).decode() == (r[1] or "") for r in rows)
    assert bpe.digests(odd_docs, path, public_tokenizers.PATTERN).count() == odd_docs.count()
    assert bpe.digests(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_op5_spaces_and_long_pretokens(multi):
    _, model, own = multi
    texts = ["  a  b \n c\n\n", " ", "\t x", "a\x1c b", "a\u3000 b", "it's we'll I'D", "ab" * 1500, "x" * 1025 + " y", "🙂" * 400, "é" * 513, "\n" * 50 + "z", "<|endoftext|> a"]
    got = model.encoder(public_tokenizers.PATTERN).ids(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [own.encode_ordinary(t) for t in texts]
    long = b"the quick brown fox" * 20
    assert model.merge_long(long).tolist() == model.encode_pretokens([long])[0].tolist()


# ---- op6


def test_op6_digests(docs, rows, odd_docs, no_docs):
    out = fingerprint.fingerprints(docs).collect()
    assert len(out) == len(rows)
    ordered = [(i, t or "") for i, t, *_ in sorted(rows, key=lambda r: r[0])]
    following = {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
    prints = defaultdict(set)
    for r in out:
        text = dict(ordered)[r.doc_id]
        half = len(text) // 2
        new = text[: len(text) - half] + following[r.doc_id][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(new) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text].add(r.fingerprint)
        if new == text:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
        if following[r.doc_id] == text:
            assert r.near_next == 1.0
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    assert fingerprint.fingerprints(odd_docs).count() == odd_docs.count()
    assert fingerprint.fingerprints(no_docs).count() == 0
    assert fingerprint.fingerprints(docs.limit(1)).count() == 1


def test_op6_entropy_and_likeness():
    draw = np.random.default_rng(2)
    buf = draw.choice(np.frombuffer(b"abcdefg   \n\xc3\xa9", np.uint8), 900)
    for i, c in enumerate(fingerprint.entropy_classes(buf).tolist()):
        total = sum(int(round(1000 * n * np.log2(n))) for n in Counter(buf[i : i + 64].tolist()).values())
        assert c == total * 1000 // fingerprint._SCALE
    rank = np.arange(fingerprint.CLASSES)
    text = bytes(draw.integers(32, 127, 6000, dtype=np.uint8))
    a, b, c = fingerprint.digests([text, text[:5000] + b"x" * 1000, bytes(draw.integers(32, 127, 6000, dtype=np.uint8))], rank)
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) > 0.6 and fingerprint.likeness(a, c) < 0.1
    assert fingerprint.likeness(a, c) == fingerprint.likeness(c, a)


# ---- op7


def test_op7_round_trip(spark, tables):
    html = [None, "", "a", "a", "<p>é</p>", "x" * 700_000, "a", "<p>é</p>", "tail"]
    pages = spark.createDataFrame([(i if i != 7 else None, f"http://h/{i}\r\nX: y é" if i % 2 else None, t, "clash") for i, t in enumerate(html)] + [(2, "http://again", "a", "")], "page_id long, url string, html string, first string").repartition(3)
    folder = tables(pages=pages)
    out = registry.QUERIES["op7_warc"](spark, folder).collect()
    assert len(out) == len(html) + 1
    least = {}
    for i, t in enumerate(html):
        if i != 7:
            least.setdefault(t or "", i)
    want = Counter()
    for i, t in [*((i if i != 7 else None, t) for i, t in enumerate(html)), (2, "a")]:
        raw = (t or "").encode()
        first = least[t or ""]
        revisit = i != first
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want


def test_op7_index_and_single_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 3000) for i in range(60)] + [(None, None, "x" * 3_000_000)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    warc.write_archive(pages, folder)
    index = warc.read_index(spark, folder)
    assert index.count() == 61 and index.select("frame").distinct().count() > 1
    for r in index.filter("record_id like '%7>'").collect():
        head, block = warc.fetch((tmp_path / "w" / r.bundle).read_bytes(), r.frame, r.offset)
        assert head["WARC-Record-ID"] == r.record_id and block.endswith(b"</p>")
    some = warc.read_archive(spark, folder, index.filter("record_id like '%7>' or record_id like '%null>'")).collect()
    assert sorted((r.page_id or -1, r.payload_bytes) for r in some) == sorted([(-1, 3_000_000), *((i, len(f"<p>{i}</p>") * 3000) for i in range(7, 60, 10))])
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader((tmp_path / "w" / index.first().bundle).read_bytes(), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 61
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0 and warc.read_index(spark, f"file://{tmp_path}/none").count() == 0


def test_op7_bundles_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    made = [x for x in warc._bundles(iter([pages_batch(200)]))]
    assert len(made) > 3
    back = [e for m in made for e in warc.entries(m.column(0)[0].as_py() + b"\x8f")]
    assert [r for r, *_ in back] == [f"<urn:x-page:{i}>" for i in range(200)]


def pages_batch(n):
    import pyarrow as pa

    html = [f"<p>{i * 7919}</p>" * 20 for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"http://h/{i}" for i in range(n)]), pa.array(html), pa.array([hashlib.sha1(h.encode()).hexdigest() for h in html]), pa.array([None] * n, pa.int64())], names=["page_id", "url", "html", "sha", "first"])


@pytest.mark.parametrize("limit", [0, 500_000])
def test_op7_copies_with_and_without_broadcast(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(keys, "BROADCAST_KEYS", limit)
    rows = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (9, "b" * 20), (8, "b" * 20), (None, "c"), (None, "c"), (1, None), (2, "")]
    pages = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string").repartition(2)
    for least, want in ((0, {(5, 3), (None, 3), (9, 8), (2, 1)}), (10, {(9, 8)})):
        folder = f"file://{tmp_path}/{least}"
        warc.write_archive(pages, folder, least=least)
        out = warc.read_archive(spark, folder).collect()
        assert len(out) == len(rows) and {(r.page_id, r.refers_to) for r in out if r.record_type == "revisit"} == want


# ---- op8


def plain_substring(rows, n=20):
    first, gone = {}, {}
    ordered = sorted(rows, key=lambda r: r[0])
    for i, text in ordered:
        w = WORD.findall(text or "")
        mark = [False] * len(w)
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if key in first:
                mark[j : j + n] = [True] * n
            else:
                first[key] = (i, j)
        gone[i] = (len(w), sum(mark), sha(" ".join(x for x, m in zip(w, mark, strict=True) if not m)))
    return gone


def test_op8_equals_plain_and_sql(spark, docs, rows, odd_docs, no_docs, tables):
    folder = tables(documents=docs.select("doc_id", "text"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.QUERIES["op8_substring_dedup"](spark, folder).collect()}
    assert got == plain_substring([(r[0], r[1]) for r in rows])
    assert any(v[1] for v in got.values())
    assert sorted((k, *v) for k, v in got.items()) == sorted((r[0], r[1], r[2], r[3]) for r in same_as_sql("op8_substring_dedup", folder).project("doc_id, n_words, n_removed, kept_sha256").fetchall())
    assert substring.repeated_windows(odd_docs).count() > 0
    assert substring.repeated_windows(no_docs).count() == 0


def test_op8_other_lengths_and_overlaps(spark):
    import random

    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(60)))) for i in range(60)] + [(100, "a " * 90), (101, "a " * 19), (102, "a b " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (20, 8, 6):
        got = {}
        texts = dict(rows)
        found = {r.did: r for r in substring.repeated_windows(docs, n).collect()}
        for i, text in rows:
            w = WORD.findall(text)
            r = found.get(i)
            keep = substring.kept_mask(len(w), bool(r and r.copy), r.runs if r else None, n)
            got[i] = (len(w), int((~keep).sum()), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)))
        assert got == plain_substring(list(texts.items()), n)


# ---- op9


def test_op9_equals_sql(spark, docs, rows, tables):
    folder = tables(documents=docs.select("doc_id", "text"))
    got = sorted(map(tuple, registry.QUERIES["op9_line_dedup"](spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    assert got == sorted(same_as_sql("op9_line_dedup", folder).project("doc_id, n_lines, n_dropped, kept_sha256").fetchall())
    assert any(r[2] for r in got)


def test_op9_runs_over_several_ranges(spark, tables):
    """One line in most documents, so that its run spans ranges; ids out of order."""
    rows = [((i * 37) % 301, f"the common line\nown line number {i}\n THE COMMON LINE\t\nshort\nshort") for i in range(301)]
    folder = tables(documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = by_id(registry.QUERIES["op9_line_dedup"](spark, folder))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 2 for i in range(1, 301))


def test_op9_runs_over_several_batches(spark, tables):
    """A long document of one line that an earlier one holds too, cut by ranges and by batches."""
    import pyarrow as pa

    names = ["h1", "h2", "did", "th", "pos", "n_lines"]
    batch = lambda h, pos: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h, h, [7] * len(h), [7] * len(h))] + [pa.array(c, pa.int32()) for c in (pos, [9] * len(h))], names=names)
    out = [r for b in lines._stream(iter([batch([1] * 3, [0, 1, 2]), batch([1, 1, 2, 3], [3, 4, 5, 6])])) for r in b.to_pylist()]
    assert [r["pos"] for r in out if r["open"] and r["h1"] == 1] == [0, 1, 2, 3, 4]

    rows = [(0, "the common line\nfirst line of all"), (1, "\n".join(["the common line"] * 3000)), (2, "the common line\nlast line of all")]
    folder = tables(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        got = {i: r.n_dropped for i, r in by_id(registry.QUERIES["op9_line_dedup"](spark, folder)).items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {0: 0, 1: 3000, 2: 1}


def test_op9_odd_tables(odd_docs, no_docs):
    kept = lines.line_dedup(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() > 0
    assert lines.line_dedup(no_docs).count() == 0
    assert lines.line_key(" \tABCÉdefghij\r".encode(), 10) == "abcÉdefghij".encode() and lines.line_key("éééééééé".encode(), 10) is None


# ---- op10


def check_packing(frame, texts, capacity=1024):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in frame.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert all(r.length == capacity for r in own[1:]) and len(own) == -(-len(ids) // capacity)
        assert all(a.start + a.length == b.start for a, b in zip(own[:-1], own[1:], strict=True)) and own[-1].start + own[-1].length == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts[:-1], parts[1:], strict=True)) and parts[-1][0] + parts[-1][1] <= capacity
    return len(sequences), sum(r.length for x in pieces.values() for r in x)


def plain_pieces(rows, capacity=1024):
    """(doc_id, start, length, crc32) of all pieces."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, end = 0, len(ids) % capacity or min(capacity, len(ids))
        while at < len(ids):
            yield i, at, end - at, zlib.crc32(ids[at:end].tobytes())
            at, end = end, end + capacity


def test_op10_pieces_and_sequences(docs, rows, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    used, total = check_packing(packing.pack(docs, path, public_tokenizers.PATTERN), {r[0]: r[1] for r in rows})
    assert used <= -(-total // 1024) + 1
    odd = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(odd_docs, path, public_tokenizers.PATTERN).collect())
    assert odd == Counter(plain_pieces([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]))
    long = [(1, "Ünique words " * 30_000), (2, "x" * 20_000)]
    texts = docs.sparkSession.createDataFrame(long, "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(texts, path, public_tokenizers.PATTERN).collect()) == sorted(plain_pieces(long))
    assert packing.pack(no_docs, path, public_tokenizers.PATTERN).count() == 0
    few = packing.pack(docs, path, public_tokenizers.PATTERN, group=8)
    check_packing(few, {r[0]: r[1] for r in rows})


def test_op10_engine_equals_tokenizers_on_all_code_points():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), packing.encoder(path, public_tokenizers.PATTERN)
    texts = []
    for lo in range(0, 0x110000, 64):
        points = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c}b {c}1 '{c}\n{c} " for c in points))
    for t, e in zip(texts, model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own(t, allowed_special="all").tolist() == e.ids
    for t in ("<|endoftext|>", " " * 70_000, "a" * 70_000):
        assert own(t, allowed_special="all").tolist() == model.encode(t, add_special_tokens=False).ids
    model.encode_special_tokens = True  # plain text, as the other operators take it
    assert own("a<|endoftext|>", disallowed_special=()).tolist() == model.encode("a<|endoftext|>", add_special_tokens=False).ids


def test_op10_added_tokens_in_texts(spark):
    """The library's default settings: an added token within a text is its one id."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), packing.encoder(path, public_tokenizers.PATTERN)
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f" {end} ", f"word {end}\n\n{end}  word's {end[:-1]} <{end}>", f"é{end}é" * 700, "<|endoftext", "<|ENDOFTEXT|>", "plain", ""]
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 50256, 65]
    assert [own(t, allowed_special="all").tolist() for t in texts] == want
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN).collect():
        got[r.doc_id].append(r)
    for i, ids in enumerate(want):
        raw = np.array([*ids, 2], "<u4")
        assert sum(r.length for r in got[i]) == len(raw)
        assert all(zlib.crc32(raw[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got[i])


def test_sum_of_squares_places_where_the_sum_is_least():
    draw = np.random.default_rng(0)
    lengths = np.sort(draw.integers(1, 50, 300))[::-1]
    bins, at = packing.sum_of_squares(lengths, 64)
    level, count = [], Counter()
    for s, b, o in zip(lengths.tolist(), bins.tolist(), at.tolist(), strict=True):
        def squares(gap):
            now = count.copy()
            now[gap] -= 1
            now[gap - s] += 1
            return sum(v * v for g, v in now.items() if g and v > 0)

        open_ = [g for g, v in count.items() if v > 0 and g >= s]
        gap = 64 - o
        if open_:
            assert gap in open_ and squares(gap) == min(map(squares, open_))
            count[gap] -= 1
        else:
            assert o == 0 and b == len(level)
            level.append(0)
        if gap - s:
            count[gap - s] += 1


# ---- kernel


def test_words_and_windows():
    texts = ["", "a", " a  b\tc\n", "é\xa0x \x0b\x0cy\r", "x" * 50]
    import pyarrow as pa

    buf, off = kernel.buffers(pa.array(["skip", *texts]).slice(1))
    words = kernel.Words(buf, off)
    raw = buf.tobytes()
    for i, t in enumerate(texts):
        own = [raw[a:b].decode() for a, b, d in zip(words.start, words.end, words.doc, strict=True) if d == i]
        assert own == WORD.findall(t)
    h = words.hashes()
    again, _ = kernel.buffers(pa.array(["c b a"]))
    other = kernel.Words(again, np.array([0, 5]))
    assert other.hashes()[2] == h[list(words.doc).index(1)]
    assert len(set(h.tolist())) == len({raw[a:b] for a, b in zip(words.start, words.end, strict=True)})

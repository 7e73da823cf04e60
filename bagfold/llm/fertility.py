"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures each text: code points per token, share of byte-fallback tokens, and the entropy of its
tokens. What is usual depends on the language (or, where none is given, on the dominant script) and on the length; so
quartiles over all documents make bands for each language and each doubling of the code points, and a text
far outside its band is rejected. A class with few documents takes the band of a wider one: with its neighbouring sizes, the whole language,
the script in that size, the whole script, the whole corpus; so every document meets a band. The base rules (too few words, too many words in
repeated runs) reject beforehand and their documents don't shape the bands.

Nulls and defects: a null text has no words and fails. A null language falls to the script. Repeated rows
get equal results; empty tables give empty results; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, ship
from .kernel import SPACE, Words, as_text, blocks, mix, per_doc, run_starts, windows

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, RUN, MOST_REPEATED_PERCENT = 20, 8, 30
#: Documents that a band needs (that of the whole corpus: none); interquartile ranges (and absolute margins) that a text may lie beyond the quartiles.
LEAST_DOCS, RANGES = 30, 6.0
#: Measures are rounded to so many places for the quartiles, which are then exact, the same in every run, and need a bounded count of values.
BAND_PLACES = 3
#: Limits are broadcast up to so many rows (a few hundred bytes each); beyond, the join shuffles.
BROADCAST_BANDS = 10_000
MARGIN = {"chars_per_token": 0.15, "byte_share": 0.03, "entropy_ratio": 0.08}

# First bytes of UTF-8 sequences by script.
SCRIPTS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD4)],
    "semitic": [*range(0xD6, 0xDC)],
    "indic": [0xE0],
    "east_asian": [*range(0xE3, 0xEE)],
}

MEASURES = (
    "band_key string, script string, n_chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, entropy_ratio double"
)

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_MODELS: dict[str, tuple] = {}


def _model(path: str) -> tuple:
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = model, np.array([model.is_byte(i) for i in range(model.vocab_size())])
    return _MODELS[path]


def repeated_run_words(words: Words, n: int = RUN) -> np.ndarray:
    """Per document, words inside runs of ``n`` words that it holds twice or more."""
    h, at = windows(words.hashes(), words.bounds, n)
    if not len(at):
        return np.zeros(len(words.count), np.int64)
    key = mix(h + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(words.count), np.int64)
    hit = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + n, -1)
    return per_doc(np.cumsum(change[:-1]) > 0, words.bounds)


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def token_measures(ids: list[list[int]], is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy (bits) of each text."""
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
    bounds = np.concatenate([[0], np.cumsum(n)])
    fallback = per_doc(is_byte[flat], bounds)
    key = np.sort(np.repeat(np.arange(len(n)), n) * len(is_byte) + flat)
    first = np.flatnonzero(run_starts(key)) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    total = np.bincount(key[first] // len(is_byte), count * np.log2(count), len(n)) if len(key) else np.zeros(len(n))
    safe = np.maximum(n, 1)
    return n, fallback, np.maximum(np.log2(safe) - total / safe, 0.0)


def _script(buf: np.ndarray, off: np.ndarray) -> list[str]:
    share = np.stack([per_doc(np.isin(np.arange(256), lead)[buf], off) for lead in SCRIPTS.values()])
    names = list(SCRIPTS)
    return [f"script:{names[i]}" if m else "script:other" for i, m in zip(share.argmax(0).tolist(), share.max(0).tolist(), strict=True)]


def _measure(path: str, carry: list[str], lang: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, is_byte = _model(path)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch, buf, off in blocks(batches, text):
            words = Words(buf, off)
            lead = (buf & 0xC0) != 0x80
            chars = per_doc(lead, off)
            tokens, fallback, entropy = token_measures(model.encode(as_text(batch.column(text)).to_pylist(), num_threads=1), is_byte)
            key = batch.column(lang).to_pylist()
            script = _script(buf, off)
            key = [f"lang:{x}" if x is not None else s for x, s in zip(key, script, strict=True)]
            some = np.maximum(tokens, 1)
            raw = buf.tobytes()
            lines = [dup_lines(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            columns = [chars, words.count, per_doc(lead & ~SPACE[buf], off), per_doc(_SYMBOL[buf], off), np.array(lines, np.int64), repeated_run_words(words), tokens]
            ratios = [chars / some, fallback / some, entropy, entropy / np.maximum(np.log2(some), 1.0)]
            m = pa.StructArray.from_arrays([pa.array(key, pa.string()), pa.array(script, pa.string()), *(pa.array(c.astype(np.int64)) for c in columns), *(pa.array(c) for c in ratios)], names)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(c) for c in carry], carry), m], names=["doc", "m"])

    return run


def measures(docs: DataFrame, path: str, carry: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc`` (the columns ``carry``) and ``m`` (base counts, fertility, base verdict, size class) of every row."""
    ship(docs.sparkSession)
    own = T.StructType([docs.schema[c] for c in carry])
    schema = T.StructType([T.StructField("doc", own), T.StructField("m", T._parse_datatype_string(MEASURES))])
    rows = docs.select(*[f"`{c}`" for c in dict.fromkeys([*carry, lang, text])])
    found = rows.mapInArrow(_measure(path, carry, lang, text), schema)
    failed = (F.col("m.n_words") < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > MOST_REPEATED_PERCENT * F.col("m.n_words"))
    # by code points: bytes in place of characters make tokens many, and a text mustn't choose its class so
    size = F.floor(F.log2(F.greatest("m.n_chars", F.lit(1)))).cast("int")
    return found.withColumn("m", F.col("m").withField("base_failed", failed).withField("size_class", size))


#: A class of documents, and the pools that may give its band, narrow ones first: (rank, key, size).
CELL = ["band_key", "script", "size_class"]
WHOLE, ANY_SIZE = 5, -9


def _pool(rank: int, key: Column, size: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), key.alias("key"), size.cast("int").alias("size"))


def _pools(near: list[int]) -> Column:
    """The pools of a class; ``near``: distances of the sizes whose widened pools are meant."""
    key, script, size, every = F.col("band_key"), F.col("script"), F.col("size_class"), F.lit(ANY_SIZE)
    return F.array(_pool(0, key, size), *[_pool(1, key, size + d) for d in near], _pool(2, key, every), _pool(3, script, size), _pool(4, script, every), _pool(WHOLE, F.lit(""), every))


def bands(found: DataFrame) -> DataFrame:
    """Limits for each class of documents that pass the base rules: quartiles over its narrowest pool with enough of them."""
    passed = found.select("m.*").filter("not base_failed")
    cells = materialize(passed.groupBy(*CELL).agg(F.count("*").alias("docs")), "band-classes")
    member = cells.select(*CELL, "docs", F.explode(_pools([-1, 0, 1])).alias("pool"))
    enough = member.groupBy("pool").agg(F.sum("docs").alias("pool_docs")).filter((F.col("pool_docs") >= LEAST_DOCS) | (F.col("pool.rank") == WHOLE)).select("pool")
    chosen = cells.select(*CELL, F.explode(_pools([0])).alias("pool")).join(enough, "pool").groupBy(*CELL).agg(F.min("pool").alias("pool"))
    chosen = materialize(chosen, "band-pools")
    member = member.drop("docs").join(chosen.select("pool").distinct(), "pool", "left_semi")
    if cells.count() <= BROADCAST_BANDS:
        member = F.broadcast(member)
    rounded = passed.select(*CELL, *[F.round(m, BAND_PLACES).alias(m) for m in MARGIN])
    out = rounded.join(member, CELL).groupBy("pool").agg(*[F.percentile(m, [0.25, 0.75]).alias(m) for m in MARGIN])
    for m, margin in MARGIN.items():
        reach = F.greatest(RANGES * (F.col(m)[1] - F.col(m)[0]), F.lit(margin))
        out = out.withColumn(f"{m}_low", F.col(m)[0] - reach).withColumn(f"{m}_high", F.col(m)[1] + reach)
    limits = out.select("pool", F.struct(*[f"{m}_{s}" for m in MARGIN for s in ("low", "high")]).alias("band"))
    return chosen.join(limits, "pool").select(*CELL, "band")


def verdicts(found: DataFrame) -> DataFrame:
    """doc, m and ``kept``. ``found`` is read three times, so it should be a written table."""
    limits = materialize(bands(found), "bands")
    if limits.count() <= BROADCAST_BANDS:
        limits = F.broadcast(limits)
    inside = {m: (F.col(f"m.{m}") >= F.col(f"band.{m}_low"), F.col(f"m.{m}") <= F.col(f"band.{m}_high")) for m in MARGIN}
    # few fallback bytes are never a fault
    good = inside["chars_per_token"][0] & inside["chars_per_token"][1] & inside["entropy_ratio"][0] & inside["entropy_ratio"][1] & inside["byte_share"][1]
    judged = found.withColumns({c: F.col(f"m.{c}") for c in CELL}).join(limits, CELL, "left")
    # a class without a band has no document that passes the base rules
    return judged.select("doc", "m", (~F.col("m.base_failed") & F.coalesce(good, F.lit(False))).alias("kept"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = materialize(measures(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"]), "fertility")
    return verdicts(found).select(
        "doc.doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", *[f"m.{c}" for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy", "entropy_ratio", "band_key")]
    )


def keep_fit(docs: DataFrame, path: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    found = materialize(measures(docs, path, docs.columns, text, lang), "fertility")
    return verdicts(found).filter("kept").select("doc.*")

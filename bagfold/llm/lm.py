"""Scores of texts by a causal self-attention model over subword ids, and by unigram counts of words.

Words of the training documents are counted over the corpus (packed by bucket); scores of unigrams add up what the broadcast list of the most frequent
words says and, for the others, what a join says. Texts are encoded once, with A-Z lower-cased, and their ids written packed in 16 bits.
Counts of ids over all training documents give the model its rows, classes and shares. The
model (``attention``) is then trained in ``ROUNDS`` rounds, each over its share of the training documents: every task takes steps from the
common model over the documents that it has, and the tasks' models are averaged, weighted by ids, on the executors (a fixed number of numbers reaches the driver). Each
id of a training document, and its end, is in one step's loss. At last all documents are scored in overlapping windows, each id once.

Nulls and defects: a null text is empty and has only its end; a null doc_id has remainder 0 and so trains. Texts are taken whole, in windows. Repeated rows count each
and score alike up to rounding of 32-bit sums. Without training documents all counts are 0, base scores are 0 and ids are equally likely within classes. Other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .attention import Adam, Shape, Vocabulary, flatten, gradient, log_likelihood, start, unflatten, windows
from .chunks import HashedMemo
from .kernel import LOWER, Words, binary_array, blocks, per_doc, pieces, span_hashes, trim
from .packing import encoder, vocabulary
from .tally import COUNTS, Tally, distinct, find, frequent, rest_sums, summed, totals

SHAPE = Shape()
#: Rounds of training, their learning rates, and windows of a step.
ROUNDS, RATES, STEP_WINDOWS = 4, (0.02, 0.01, 0.005, 0.0025), 128
#: Words of the broadcast list (16 bytes each), windows that are scored at once, and pieces in which models are averaged.
LISTED, BATCH, PARTS = 1 << 17, 128, 16

TEXTS = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, listed double, rest binary, ids binary"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 7 == 2


def _word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(buf, off)
    return words, span_hashes(LOWER[buf], words.start, words.end).view(np.int64)


def _word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(buckets)
        for _, buf, off in blocks(batches):
            yield from tally.add(*distinct(_word_hashes(buf, off)[1]))
        yield from tally.close()

    return run


def _described(keys: np.ndarray, logs: np.ndarray):
    """Of the words of each chunk, lower-cased: how many, how many of them listed (``keys``, sorted), what the list says of these; and the hashes of the others."""

    def run(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        words, h = _word_hashes(buf, off)
        at, there = find(keys, h)
        value = np.bincount(words.doc, np.where(there, logs[at], 0.0) if len(logs) else None, len(off) - 1) * bool(len(logs))
        known = per_doc(there, words.bounds)
        return [words.count, known, value], words.count - known, h[~there]

    return run


def _encoded(path: str, pattern: str, known, ends: bool, sizes):
    """TEXTS rows; ``known``: sorted hashes and counts of frequent words; ``ends``: whether the end of a text is a known token; ``sizes``: bytes of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        keys, counts = known.value
        memo = HashedMemo(lambda text: encode(text, disallowed_special=()), sizes.value, _described(keys, np.log10(counts + 1.0)))
        for batch, buf, off in blocks(batches):  # rid, doc_id, held_out, text
            rows, bounds = memo.find(LOWER[buf], off)
            words, listed, value = (x[rows] for x in memo.more) if len(rows) else (rows, rows, rows)
            total = np.append(0.0, np.cumsum(value))[bounds]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(per_doc(words, bounds) + 1), pa.array(per_doc(listed, bounds) + int(ends)), pa.array(np.diff(total)), memo.packed_keys(rows, bounds), memo.packed(rows, bounds)], names=[x.split()[0] for x in TEXTS.split(", ")]
            )

    return run


def _flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of packed rows, and how many each row has."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), "<u2"), np.diff(off) // 2


def _id_counts(buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in pieces(batches, 0):
            total += np.bincount(_flat_ids(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        tally = Tally(buckets)
        yield from tally.add(some, total[some])
        yield from tally.close()

    return run


def _sequences(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before each id, the ids with an end behind each text, and the texts' lengths."""
    ids, n = _flat_ids(column)
    length = n + 1
    stop = np.cumsum(length) - 1
    after = np.empty(int(length.sum()), np.int64)
    inside = np.ones(len(after), bool)
    inside[stop] = False
    after[inside], after[stop] = ids, end
    return np.append(end, after[:-1]), after, length


def _cut(before: np.ndarray, after: np.ndarray, length: np.ndarray, voc: Vocabulary, shape: Shape, overlap: int | None = None):
    """Windows of a block: text of each, places that count, rows and ids."""
    doc, first, skip, size = windows(length, shape, overlap)
    place = np.arange(shape.window)
    at = np.minimum((np.cumsum(length) - length)[doc][:, None] + first[:, None] + place, max(len(after) - 1, 0))
    return doc, (place >= skip[:, None]) & (place < size[:, None]), voc.slot[before[at]], after[at]


def _trained(model, voc, shape: Shape, rate: float):
    """The model after steps over this task's rows (rid, ids), in ``PARTS`` pieces with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = unflatten(model.value, shape), voc.value
        adam, seen, held = Adam(now, rate), 0, []

        def step(part) -> int:
            slots, classes, scored = (np.concatenate(x) for x in zip(*part, strict=True))
            adam.step(now, gradient(now, slots, classes, scored, shape, with_loss=False)[1])
            return int(scored.sum())

        for batch in pieces(batches, 1, 1 << 19):
            _, scored, slots, ids = _cut(*_sequences(batch.column(1), words.end), words, shape, 0)
            for lo in range(0, len(slots), STEP_WINDOWS):
                held.append((slots[lo : lo + STEP_WINDOWS], words.cls[ids[lo : lo + STEP_WINDOWS]], scored[lo : lo + STEP_WINDOWS]))
                if sum(len(x[0]) for x in held) >= STEP_WINDOWS:
                    seen += step(held)
                    held = []
        if held:
            seen += step(held)
        if seen:
            flat = np.array_split(flatten(now).astype(np.float64) * seen, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, float(seen))), pa.array([x.tobytes() for x in flat], pa.binary())], names=["part", "weight", "values"])
        trim()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for p, w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.frombuffer(v.as_buffer(), np.float64)
            held[p] = [held[p][0] + w, held[p][1] + x] if p in held else [w, x]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([w for w, _ in held.values()]), pa.array([x.tobytes() for _, x in held.values()], pa.binary())], names=["part", "weight", "values"])


def train(texts: DataFrame, voc: Vocabulary, shape: Shape = SHAPE, rounds: int = ROUNDS, rates: tuple[float, ...] = RATES) -> np.ndarray:
    """The model (flat) from the rows of ``texts`` that aren't held out."""
    spark = texts.sparkSession
    width = shuffle_width(spark)
    flat, words = flatten(start(shape, voc)), spark.sparkContext.broadcast(voc)
    models = "part int, weight double, values binary"
    for r in range(rounds):
        share = texts.filter(~F.col("held_out") & (F.pmod(F.xxhash64("rid"), F.lit(rounds)) == r)).select("rid", "ids")
        own = share.coalesce(width).mapInArrow(_trained(spark.sparkContext.broadcast(flat), words, shape, rates[min(r, len(rates) - 1)]), models)
        sums = own.repartitionById(min(width, PARTS), F.col("part") % min(width, PARTS)).mapInArrow(_added, models).collect()
        if sums:
            flat = np.concatenate([np.frombuffer(x["values"], np.float64) / x["weight"] for x in sorted(sums, key=lambda x: x["part"])]).astype(np.float32)
    return flat


def _scores(model, voc, shape: Shape):
    """TEXTS rows without ids and with ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = unflatten(model.value, shape), voc.value
        ten = 1 / np.log(10)
        for batch in pieces(batches, 7, 1 << 19):
            before, after, length = _sequences(batch.column(7), words.end)
            doc, scored, slots, ids = _cut(before, after, length, words, shape)
            total = np.bincount(np.repeat(np.arange(len(length)), length), words.share[after], len(length))
            lead = scored[:, 0]  # the other windows score none of their first places, so those need no states
            for group in (np.flatnonzero(lead), np.flatnonzero(~lead)):
                for lo in range(0, len(group), BATCH):
                    some = group[lo : lo + BATCH]
                    part = scored[some]
                    z = log_likelihood(now, slots[some], words.cls[ids[some]], part, shape)
                    own = doc[some]
                    total[own[0] : own[-1] + 1] += np.bincount(np.repeat(own - own[0], part.sum(1)), z.astype(np.float64), own[-1] + 1 - own[0]) * ten
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(total)], names=[*batch.schema.names[:7], "score"])
        trim()

    return run


def id_counts(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids in the training rows; the last is the end of a text. At most ``size`` numbers reach the driver."""
    width = shuffle_width(texts.sparkSession)
    own = texts.filter(~F.col("held_out"))
    counts = np.zeros(size, np.int64)
    for r in totals(own.select("ids").mapInArrow(_id_counts(width, size), COUNTS), width).collect():
        counts[r.key] = r.n
    counts[size - 1] = own.count()
    return counts


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", listed: int = LISTED) -> tuple[DataFrame, DataFrame, int, int]:
    """TEXTS, written; counts of the training words (key, n); and how many training tokens there are, in all and distinct."""
    spark = docs.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(f"`{text}`").alias("text"))
    own = rows.filter(~F.col("held_out")).select("text")
    words = materialize(totals(own.mapInArrow(_word_counts(width), COUNTS), width), "words")
    total, many = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.filter(~held_out(doc_id)).count()
    few = frequent(words, listed)[0].toArrow().sort_by("key")
    known = spark.sparkContext.broadcast((few.column("key").to_numpy(), few.column("n").to_numpy()))
    tokens = vocabulary(path)[0]
    sizes = np.zeros(1 + max(tokens.values(), default=0), np.int32)
    sizes[list(tokens.values())] = [len(x) for x in tokens]
    texts = materialize(rows.mapInArrow(_encoded(path, pattern, known, ends > 0, spark.sparkContext.broadcast(sizes)), TEXTS), "texts")
    return texts, words, total + ends, many + (ends > 0), ends


def score(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", shape: Shape = SHAPE, listed: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    texts, words, total, many, ends = encoded(docs, path, pattern, doc_id, text, listed)
    tokens, added = vocabulary(path)
    voc = Vocabulary(id_counts(texts, 1 + max(tokens.values(), default=0) + len(added)), shape)
    model = train(texts, voc, shape)
    cast = spark.sparkContext.broadcast
    out = materialize(texts.mapInArrow(_scores(cast(model), cast(voc), shape), TEXTS.replace("ids binary", "score double")), "scores")
    more = rest_sums(out, words.select("key", F.log10(F.col("n") + 1.0).alias("more"), F.lit(1).cast("long").alias("known")), "more", "known")
    out = out.drop("rest").join(more, "rid", "left")
    spread = float(np.log10(total + 1.0 * (many + 1)))
    base = F.col("listed") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(spread)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op12_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

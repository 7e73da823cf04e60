"""Information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) come from fixed patterns. The values found are protected entities, on two levels: the value itself and what it belongs to (domain,
network, dial prefix, issuer). Every word of a document that holds an entity is a term; over the whole corpus, with documents counted by distinct text,

    PMI(e, t) = log2(N n(e, t) / (n(e) n(t)))      IC(e) = log2(N / n(e))      left(e, t) = log2((n(t) + 1) / n(e, t))

``left`` is how many bits are still missing to the entity for one who knows the term, where each term is taken to stand in one more text without the entity. Terms that leave at
most ``GENERALISE`` bits are generalised, those that leave at most ``REMOVE`` are removed, wherever they stand in the documents that hold that entity, if PMI is ``LEAST_SHARE`` of IC at least.
So a term of a single text, which leaves one bit, never goes. A generalised term is replaced by what the value belongs to, or, where that stands in the same texts as the
value, by its kind.

Entities with the same set of texts are one class, and so are terms; pairs are counted between classes of a text, so a list of many addresses and many words makes few
pairs. The holders' texts say how many texts a term has at least; the terms that this leaves open are counted exactly in all texts (not at all if there are none), and a bit map of
fixed size over them thins what the count has to shuffle.

Nulls and defects: a null text is empty; very long ones are taken whole. Rows are told apart by doc_id (null: an own one) and text hash; repeated rows get equal results. Documents
without personal data stay as they are. Other columns pass by; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .kernel import LOWER, as_text, blocks, mix, per_doc, pieces, run_starts, signed, span_hashes
from .keys import small
from .lines import doc_key
from .tally import COUNTS, Tally, distinct, totals

# Kinds in their order and patterns.
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A digit run is tried from its start only: later starts in it fail alike, and matches end with a run.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}

#: Bits that a term may leave to the entity, and the share of the entity's information that it must tell.
GENERALISE, REMOVE, LEAST_SHARE = 0.9, 0.6, 0.5
TERM = re.compile(r"[^\W\d_](?:[^\W_]|['’-])*[^\W_]")
MAP_BITS = 1 << 22

SPAN = "struct<start:int,kind:int,end:int,label:string>"
PLACE = "struct<term:long,start:int,end:int>"
ENTITY = "struct<entity:long,level:int,kind:int,up:string>"
FOUND = f"doc_id long, did long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, entities array<{ENTITY}>, near array<{PLACE}>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if len(m.group()) >= 12 and 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


def levels(kind: int, value: str) -> tuple[str, str]:
    """The value as it is told apart, and what it belongs to: domain, network, issuer or dial prefix."""
    if kind == 0:
        own = value.lower()
        return own, own[own.rindex("@") + 1 :]
    if kind == 1:
        own = ".".join(str(int(x)) for x in value.split("."))
        return own, own[: own.rindex(".")]
    own = re.sub("[^0-9]", "", value)
    return own, own[:6] if kind == 2 else f"+{own[:4]}"


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    import xxhash

    out = {}
    for a, k, b in spans:
        own, up = levels(k, text[a:b])
        for level, value in enumerate((own, up)):
            h = xxhash.xxh3_64_intdigest(f"{k}:{level}:{value}".encode()) - (1 << 63)
            out[h] = {"entity": h, "level": level, "kind": k, "up": up}
    return [out[h] for h in sorted(out)]


def term_hash(terms: list[str]) -> np.ndarray:
    """Hashes without regard to ASCII case."""
    raw = [t.encode() for t in terms]
    end = np.cumsum([len(t) for t in raw])
    return span_hashes(LOWER[np.frombuffer(b"".join(raw), np.uint8)], end - np.array([len(t) for t in raw]), end)


def doc_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end): the terms of a text, outside all spans (in order)."""
    out, i, far = [], 0, 0
    for m in TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            far = max(far, spans[i][2])
            i += 1
        if far <= m.start():
            out.append((m.group(), m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_DIGIT = np.isin(np.arange(256), np.arange(48, 58))


def _maybe(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents of a block that may hold base spans."""
    return (per_doc(_DIGIT[buf], off) >= 4) | (per_doc(buf == 64, off) > 0)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()),
                        ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))),
                        ("entities", pa.list_(pa.struct([("entity", pa.int64()), ("level", pa.int32()), ("kind", pa.int32()), ("up", pa.string())]))), ("near", pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))])
    for batch, buf, off in blocks(batches):  # doc_id, did, th, text
        texts = as_text(batch.column(3))
        maybe = _maybe(buf, off)
        count, sha, base, entities, near = np.zeros((4, batch.num_rows), np.int64), [nothing] * batch.num_rows, *([[]] * batch.num_rows for _ in range(3))
        for i in np.flatnonzero(maybe).tolist():
            text = texts[i].as_py()
            spans = base_spans(text)
            if not spans:
                continue
            for _, k, _ in spans:
                count[k, i] += 1
            sha[i] = hashlib.sha256(joined(spans).encode()).hexdigest()
            base[i] = [{"start": a, "kind": k, "end": b} for a, k, b in spans]
            entities[i] = entities_of(text, spans)
            if terms := doc_terms(text, spans):
                hashes = signed(term_hash([t for t, _, _ in terms])).tolist()
                near[i] = [{"term": h, "start": a, "end": b} for (_, a, b), h in zip(terms, hashes, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in count), pa.array(sha), pa.array(base, schema.field("base").type), pa.array(entities, schema.field("entities").type), pa.array(near, schema.field("near").type)], schema=schema)


def _counts(wanted, buckets: int):
    """Texts of this task that hold a term whose bit is set, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tally = wanted.value, Tally(buckets)
        for batch, buf, off in blocks(batches):
            maybe, terms, doc = _maybe(buf, off), [], []
            for i, text in enumerate(as_text(batch.column(0)).to_pylist()):
                spans = base_spans(text) if maybe[i] else []
                own = {t for t, _, _ in doc_terms(text, spans)} if spans else set(TERM.findall(text))
                terms += own
                doc += [i] * len(own)
            if not terms:
                continue
            h, doc = term_hash(terms), np.array(doc, np.int64)
            slot = (mix(h) & np.uint64(MAP_BITS - 1)).astype(np.int64)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            h, doc = h[hit], doc[hit]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            yield from tally.add(*distinct(h[run_starts(h, doc)] if len(h) else h))
        yield from tally.close()

    return run


def _bit_map(terms: DataFrame) -> np.ndarray:
    """Bits of the terms: at most ``MAP_BITS``, whatever their number."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = (mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(MAP_BITS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(slot & 63)], names=["word", "bit"])

    words = terms.mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint8)


def left_bits(n_term: str, both: str) -> Column:
    """How far a term leaves one from the entity."""
    return F.log2(F.col(n_term) + 1.0) - F.log2(both)


def tells(n_term: str, both: str, n_entity: str, total: int) -> Column:
    """Whether a term is to be generalised or removed."""
    information = F.log2(F.lit(float(max(total, 1)))) - F.log2(n_entity)
    pmi = information + F.log2(both) - F.log2(n_term)
    return (left_bits(n_term, both) <= GENERALISE) & (information > 0) & (pmi >= LEAST_SHARE * information - 1e-9)


def _each_text(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``text`` of one of the rows of each text hash; ``found`` is a written table with the rows' keys."""
    keys = found.groupBy("did", "th").agg(F.count("*").alias("rows"))
    first = keys.groupBy("th").agg(F.min("did").alias("did"))
    later = small(materialize(keys.select("did", "th").join(first, ["did", "th"], "left_anti"), "later-copies"))
    twice = small(materialize(keys.filter("rows > 1").join(first, ["did", "th"], "left_semi").select("did", "th"), "repeated-rows"))
    once = rows.select("did", "th", "text").join(later, ["did", "th"], "left_anti")
    if not twice.isEmpty():  # of repeated rows one counts
        once = once.join(twice, ["did", "th"], "left_anti").unionByName(once.join(twice, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]))
    return once.select("text")


def _classes(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (th, key, ...; each pair once) by key: how many texts, and two numbers that stand for the set of texts."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("th")).alias("x"), F.bit_xor(F.xxhash64("th", F.lit(1))).alias("y")).filter("n > 1")


def _classed(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table`` (written, n: rows of the key). Keys of very many rows, of which there are at most ``HOT_KEYS``, are joined by broadcast."""
    hot = table.filter(F.col("n") > max(HOT_ROWS, (table.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS))
    if hot.isEmpty():
        return rows.join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key))


#: Keys with over a thousandth of the rows, and over so many rows.
HOT_KEYS, HOT_ROWS = 1000, 10_000


def disclosing(found: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(th, term, kind, label): which terms go in which texts; None if none can."""
    spark = found.sparkSession
    first = small(materialize(found.filter(F.size("entities") > 0).groupBy("th").agg(F.min("did").alias("did")).select("did", "th"), "holders"))
    texts = found.filter(F.size("entities") > 0).select("did", "th", "entities", F.array_distinct(F.col("near.term")).alias("terms")).join(first, ["did", "th"], "left_semi")
    texts = materialize(texts.dropDuplicates(["did", "th"]).select("th", "entities", "terms"), "holder-texts")
    held = texts.select("th", F.explode("entities").alias("e")).select("th", "e.*")
    owners = _classes(held.select("th", "entity"), "entity").join(held.groupBy("entity").agg(F.min("level").alias("level"), F.min("kind").alias("kind"), F.min("up").alias("up")), "entity")
    # entities of one set of texts are one class; it is called by what its values belong to, if that is one and stands in more texts
    owners = materialize(owners, "entities")
    if owners.isEmpty():
        return None
    mark = F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS[:4]]), F.col("kind") + 1)))
    called = F.when((F.max("level") == 0) & (F.min("up") == F.max("up")), F.concat(F.min(mark), F.lit(" "), F.min("up"), F.lit("]"))).otherwise(F.concat(F.min(mark), F.lit("]")))
    called = materialize(owners.groupBy("n", "x", "y").agg(called.alias("label")).select(F.col("n").alias("n_entity"), F.col("x").alias("ex"), F.col("y").alias("ey"), "label"), "entity-classes")
    holdings = _classed(held.select("th", "entity"), owners.select("entity", "n", "x", "y"), "entity").select("th", F.col("n").alias("n_entity"), F.col("x").alias("ex"), F.col("y").alias("ey")).distinct()
    holdings = materialize(holdings, "holdings")
    # only texts that still have an entity can show a term with it, but all holders' texts count for the term
    said = texts.select("th", F.explode("terms").alias("term"))
    terms = materialize(_classes(said, "term"), "terms")
    places = _classed(said.join(holdings.select("th").distinct(), "th", "left_semi"), terms, "term").select("th", "term", F.col("n").alias("within"), "x", "y")
    places = materialize(places, "term-places")
    total = found.select("th").distinct().count()
    own = ["within", "x", "y"]
    # an entity that stands in fewer texts than the term would need isn't tried
    possible = F.log2(F.col("within") + 1.0) - F.log2("n_entity") <= GENERALISE
    pairs = places.select("th", *own).distinct().join(holdings, "th").filter(possible).groupBy(*own, "n_entity", "ex", "ey").agg(F.count("*").alias("both"))
    pairs = materialize(pairs.filter(tells("within", "both", "n_entity", total)), "class-pairs")
    open_terms = materialize(terms.select("term", F.col("n").alias("within"), "x", "y").join(pairs.select(*own).distinct(), own), "open-terms")
    if open_terms.isEmpty():
        return None
    wanted = spark.sparkContext.broadcast(_bit_map(open_terms.select("term")))
    width = shuffle_width(spark)
    counts = totals(_each_text(rows, found).mapInArrow(_counts(wanted, width), COUNTS), width).withColumnRenamed("key", "term")
    counted = materialize(open_terms.join(counts, "term", "left").withColumn("n_term", F.greatest("n", "within")).drop("n"), "term-counts")
    level = F.when(left_bits("n_term", "both") <= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    told = counted.join(pairs, own).filter(tells("n_term", "both", "n_entity", total)).select("term", "n_entity", "ex", "ey", level.alias("kind"))
    told = materialize(told, "told")
    at = places.select("th", "term").join(told, "term").join(holdings, ["th", "n_entity", "ex", "ey"], "left_semi").join(called, ["n_entity", "ex", "ey"])
    return at.groupBy("th", "term").agg(F.max("kind").alias("kind"), F.min("label").alias("label"))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """FOUND (without ``entities`` and ``near``) and ``terms``: the spans of disclosing terms."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *doc_key(doc_id, text), F.col(f"`{text}`").alias("text"))
    found = materialize(rows.mapInArrow(_find, FOUND), "personal-data")
    told = disclosing(found, rows)
    if told is None:
        return found.drop("entities", "near").withColumn("terms", F.lit(None).cast(f"array<{SPAN}>"))
    told = materialize(told, "disclosing")
    places = found.filter(F.size("near") > 0).join(small(materialize(told.select("th").distinct(), "told-texts")), "th", "left_semi").select("did", "th", F.explode("near").alias("c")).select("did", "th", "c.*")
    spans = places.join(told, ["th", "term"]).select("did", "th", "start", "kind", "end", "label").distinct()
    spans = spans.groupBy("did", "th").agg(F.collect_list(F.struct("start", "kind", "end", F.when(F.col("kind") == KINDS.index("generalise"), F.col("label")).alias("label"))).alias("terms"))
    return found.drop("entities", "near").join(spans, ["did", "th"], "left")


def with_spans(found: DataFrame) -> DataFrame:
    """``found`` with ``all`` spans in order and ``spans``, their text form."""
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.expr(f"cast(array() as array<{SPAN}>)"))))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return found.withColumn("all", every).withColumn("spans", text)


def op1_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(personal_data(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def masked(text: str, spans: list[tuple]) -> str:
    """Each run of overlapping spans (start, kind, end and perhaps a label) becomes the mark of its first."""
    out, at = [], 0
    for a, k, b, *label in spans:
        if a >= at:
            out += [text[at:a], label[0] if label and label[0] else MASKS[KINDS[k]]]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data masked and disclosing terms generalised or removed in ``text``."""
    schema, at = docs.schema, docs.columns.index(text)
    spans = with_spans(personal_data(docs, doc_id, text)).filter(F.size("all") > 0).select("did", "th", "all").dropDuplicates(["did", "th"])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = [t if not s else masked(t, [(x["start"], x["kind"], x["end"], x["label"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)], names=schema.names)

    did, th = doc_key(doc_id, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), did, th).join(spans, ["did", "th"], "left")
    return rows.select("doc.*", F.col("all").alias("__all")).mapInArrow(mask, schema)

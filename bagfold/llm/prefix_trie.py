"""Prefix trie of conversations, rolled up by pointer jumping.

Turns are sorted into ranges by conversation and place. Each range is streamed once for places and prefix digests; what a conversation has in
earlier ranges is carried over (one row a range), so one of any length is spread over many tasks. A digest is the sum of the turns' hashes times powers of
an odd number, modulo 2**64, in two lanes: 128 bits name a node, and its parent's name follows from the same sums. Subtree sums take
logarithmically many rounds: a node holds the sums of its descendants nearer than 2**k and the name of its ancestor 2**k above;
each round adds what the nodes 2**k below hold and doubles the pointer. Pointers to an ancestor that very many nodes share are looked up in a broadcast
table, which by its threshold never has over ``HOT_KEYS`` rows; all others by a shuffle.

Nulls and defects: a null role or text is empty, a null turn comes first; turns of one number are ordered by the digest of role and text, and repeated
rows are turns each. Rows without a conv_id belong to no conversation and are left out. Texts of any length are only hashed and measured. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width, ship
from .kernel import mix, run_starts, signed, trim

#: Odd factors of the two lanes, and that of the depth in a node's name.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
STEP = np.uint64(0xA0761D6478BD642F)
_ALL = 1 << 64
HOT_KEYS, HOT_ROWS = 1000, 10_000
#: Ids of one row while a group's list of members is handed on.
CHUNK = 65_536

NODE = ["k1", "k2"]
UP = ["p1", "p2"]
STATE = [*NODE, "depth", *UP, "n_leaves", "saved_tokens"]


def powers(base: int, first: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = pow(base, first, _ALL)
    return np.cumprod(out)


def _turn_lanes(column: pa.Array) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)
    return [raw[:, 0], raw[:, 1]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix sums within this range: of conversation, turn digest and length, sorted."""
    pid, seq, last, held, sums = TaskContext.get().partitionId(), 0, None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        start = np.maximum.accumulate(np.where(run_starts(conv), np.arange(n), 0))
        lead = int(np.searchsorted(start, 0, "right")) if conv[0] == last else 0  # rows that go on
        place = np.arange(n) - start + 1
        place[:lead] += held
        lanes = []
        for base, hashes, before in zip(BASES, _turn_lanes(batch.column(1)), sums, strict=True):
            up = powers(base, 1, int((np.arange(n) - start).max()) + 1)[np.arange(n) - start]
            up[:lead] *= np.uint64(pow(base, held if lead else 0, _ALL))
            total = np.cumsum(hashes * up)
            own = total - np.where(start > 0, total[start - 1], np.uint64(0))
            own[:lead] += np.uint64(before)
            lanes.append(own)
        last, held, sums = conv[-1], int(place[-1]), [int(x[-1]) for x in lanes]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(place), *(pa.array(signed(x)) for x in lanes)], names=["conv", "turn_digest", "n", "pid", "seq", "place", "s1", "s2"])
        seq += n


def _carried(tails: list) -> dict[int, tuple[int, int, int, int]]:
    """By range: the conversation that goes on in it, and what earlier ranges hold of it (places, sums)."""
    out, now = {}, None
    for r in sorted(tails, key=lambda r: r.pid):
        conv, n, *sums = r.last
        if now and now[0] == r.first:
            out[r.pid] = now
            if conv == r.first:
                sums = [(before + pow(base, now[1], _ALL) * own) % _ALL for base, before, own in zip(BASES, now[2:], sums, strict=True)]
                n += now[1]
        now = (conv, n, *(s % _ALL for s in sums))
    return out


def _settled(carry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carry.value
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, pid, place = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(5).to_numpy().copy()
            lanes = [batch.column(c).to_numpy().view(np.uint64).copy() for c in (6, 7)]
            for p in np.unique(pid).tolist():
                if p in known:
                    of, n, *sums = known[p]
                    on = (pid == p) & (conv == of)
                    place[on] += n
                    for base, lane, before in zip(BASES, lanes, sums, strict=True):
                        lane[on] = np.uint64(before) + np.uint64(pow(base, n, _ALL)) * lane[on]
            above = [lane - h * _at(base, place) for base, lane, h in zip(BASES, lanes, _turn_lanes(batch.column(1)), strict=True)]
            depth = place.astype(np.uint64)
            named = [mix(lanes[0] + STEP * depth), lanes[1], mix(above[0] + STEP * (depth - np.uint64(1))), above[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(place), *(pa.array(signed(np.ascontiguousarray(x))) for x in named)], names=["conv", "turn_digest", "n", "depth", *NODE, *UP])

    return run


def _at(base: int, place: np.ndarray) -> np.ndarray:
    """Powers with any exponents, by repeated squaring."""
    out, factor, left = np.ones(len(place), np.uint64), base, place.copy()
    while left.any():
        out = np.where(left & 1, out * np.uint64(factor), out)
        factor, left = factor * factor % _ALL, left >> 1
    return out


def chained(turns: DataFrame, *order: str) -> DataFrame:
    """(conv, turn_digest, n, depth, node name, parent's name) of ``turns`` (conv, turn_digest, n and the columns that order a conversation)."""
    spark = turns.sparkSession
    ship(spark)
    rows = turns.withColumn("tie", F.monotonically_increasing_id())  # else repeated rows would all be in one range
    dealt = rows.repartitionByRange(shuffle_width(spark), "conv", *order, "tie").sortWithinPartitions("conv", *order, "tie").select("conv", "turn_digest", "n")
    local = materialize(dealt.mapInArrow(_local, "conv long, turn_digest binary, n long, pid int, seq long, place long, s1 long, s2 long"), "turn-ranges")
    tails = local.groupBy("pid").agg(F.min_by("conv", "seq").alias("first"), F.max_by(F.struct("conv", "place", "s1", "s2"), "seq").alias("last")).collect()
    carry = spark.sparkContext.broadcast(_carried(tails))
    return local.mapInArrow(_settled(carry), "conv long, turn_digest binary, n long, depth long, k1 long, k2 long, p1 long, p2 long")


def turns_of(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, turn_digest, n) of a table of turns."""
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)), 1, 16)
    return convs.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("turn_digest"), F.length(said).cast("long").alias("n")).filter("conv is not null")


def _looked_up(rows: DataFrame, table: DataFrame, kids: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns that ``table`` (written, one row a node) has of the node at p1, p2. ``kids``: rows by p1, p2."""
    limit = max(HOT_ROWS, total // HOT_KEYS)  # so many rows or more have under HOT_KEYS keys
    named = table.withColumnsRenamed(dict(zip(NODE, UP, strict=True)))
    hot = materialize(named.join(kids.filter(F.col("n") > limit).select(*UP), UP), "hot-nodes")
    if hot.isEmpty():
        return rows.join(named, UP)
    few = F.broadcast(hot)
    return rows.join(few, UP).unionByName(rows.join(few.select(*UP), UP, "left_anti").join(named, UP))


def _subtree_sums(nodes: DataFrame, kids: DataFrame, total: int, depth: int) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) over subtrees; ``nodes`` has STATE with each node's own share, ``kids`` the sums of its children."""
    far = 1
    while far <= depth:
        if kids is None:
            kids = materialize(_kids(nodes), "trie-kids")
        gained = kids.withColumnsRenamed({"p1": "k1", "p2": "k2", "n_leaves": "more_leaves", "saved_tokens": "more_saved"}).drop("n")
        now = nodes.join(gained, NODE, "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).select(*STATE)
        pointers = nodes.filter(F.col("p1").isNotNull()).select(*NODE, F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        on = _looked_up(now.filter(F.col("depth") >= 2 * far), pointers, kids, total).select(*NODE, "depth", F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_leaves", "saved_tokens")
        off = now.filter(F.col("depth") < 2 * far).withColumns({c: F.lit(None).cast("long") for c in UP})
        nodes, kids, far = materialize(on.unionByName(off), "trie-round"), None, 2 * far
    return nodes.select(*NODE, "n_leaves", "saved_tokens")


def _kids(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("p1").isNotNull()).groupBy(*UP).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.count("*").alias("n"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of runs of (k1, k2) that lie within this range; the ids of its first and last run, in pieces, as these may go on elsewhere."""
    pid, seq, first, now, sha, held = TaskContext.get().partitionId(), 0, True, None, None, []

    def row(digest: str | None, ids: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([pid], pa.int32()), pa.array([seq], pa.int64()), pa.array([digest], pa.string()), pa.array([ids], pa.binary())], names=[*NODE, "pid", "seq", "digest", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, conv = [batch.column(c).to_numpy() for c in (0, 1)], batch.column(2).to_numpy()
        edge = np.append(np.flatnonzero(run_starts(*keys)), batch.num_rows)
        done = [], [], []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            key = (int(keys[0][lo]), int(keys[1][lo]))
            if key != now:
                if now is not None and not first and not sha:  # a whole run, all of it held
                    done[0].append(now[0])
                    done[1].append(now[1])
                    done[2].append(hashlib.sha256(b",".join(held)).hexdigest())
                elif now is not None:
                    yield row(None, b",".join(held))
                    seq += 1
                first, now, sha, held = now is None, key, None, []
            for at in range(lo, hi, CHUNK):
                if len(held) >= 16:  # a long run: hand on what there is, its digest is made in the next step
                    yield row(None, b",".join(held))
                    sha, held, seq = True, [], seq + 1
                held.append(",".join(map(str, conv[at : min(at + CHUNK, hi)].tolist())).encode())
        if done[0]:
            n = len(done[0])
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array([pid] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(done[2], pa.string()), pa.nulls(n, pa.binary())], names=[*NODE, "pid", "seq", "digest", "ids"])
    if now is not None:
        yield row(None, b",".join(held))
    trim()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of runs of pieces of ids, piece by piece."""
    now, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([sha.hexdigest()])], names=[*NODE, "digest"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c) for c in range(3)), strict=True):
            if now != (a.as_py(), b.as_py()):
                if now:
                    yield row()
                now, sha = (a.as_py(), b.as_py()), hashlib.sha256(ids.as_buffer())
            else:
                sha.update(b",")
                sha.update(ids.as_buffer())
    if now:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the ascending ids of each group; a group over several ranges is hashed from pieces of ``CHUNK`` ids."""
    parts = shuffle_width(ends.sparkSession)
    dealt = ends.select(*NODE, "conv").repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    found = materialize(dealt.mapInArrow(_joined, "k1 long, k2 long, pid int, seq long, digest string, ids binary"), "ends")
    open_ = found.filter("digest is null").repartition(parts, *NODE).sortWithinPartitions(*NODE, "pid", "seq").select(*NODE, "ids")
    return found.filter("digest is not null").select(*NODE, "digest").unionByName(open_.mapInArrow(_hash_pieces, "k1 long, k2 long, digest string")).withColumnRenamed("digest", "ends_sha256")


def trie(chains: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``chains`` (as ``chained`` gives them); ``convs`` (conv) also has those without turns."""
    chains = materialize(chains.select("conv", "n", "depth", *NODE, *UP), "chains")
    nodes = chains.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n").alias("n"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("n"))
    nodes = materialize(nodes.unionByName(root), "trie-nodes")
    total, depth = nodes.agg(F.count("*"), F.max("depth")).first()
    if not total:
        depth = 0
    children = materialize(nodes.filter("depth > 0").groupBy(*UP).agg(F.count("*").alias("n")), "trie-children")
    born = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("n").alias("n_children"))
    facts = nodes.join(born, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    facts = materialize(facts.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n")), "trie-facts")
    sums = _subtree_sums(facts.select(*STATE), None, total, depth)
    named = facts.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    lower = _looked_up(facts.filter("depth > 0"), named, children, total)
    every = lower.unionByName(facts.filter("depth = 0").withColumn("parent_conv_id", none)).drop("n_leaves", "saved_tokens")
    last = chains.groupBy("conv").agg(F.max(F.struct("depth", *NODE)).alias("e")).select("conv", "e.k1", "e.k2")
    ends = convs.join(last, "conv", "left").select("conv", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NODE))
    nothing = hashlib.sha256(b"").hexdigest()
    out = every.join(sums, NODE).join(ends_digests(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table of conversations as they are."""
    turns = turns_of(convs, conv_id, turn, role, text)
    return trie(chained(turns, "turn", "turn_digest"), turns.select("conv").distinct())


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Chains of conversations whose first turns (crc32 of the id, modulo ``most``) are those of the first conversation of their block of ids; and all ids."""
    own = materialize(chained(turns, "turn", "turn_digest").select("conv", "turn_digest", "n", F.col("depth").alias("place")), "turns")
    taken: Column = F.crc32(F.col("conv").cast("string")) % most
    convs = materialize(own.select("conv").distinct(), "convs")
    heads = own.filter((F.col("conv") % block == 0) & (F.col("place") < most)).withColumnRenamed("conv", "lead")
    given = convs.withColumn("lead", F.col("conv") - F.col("conv") % block).withColumn("h", taken).join(heads, "lead").filter("place <= h")
    rows = given.select("conv", F.lit(0).alias("part"), "place", "turn_digest", "n").unionByName(own.filter(F.col("place") > taken).select("conv", F.lit(1).alias("part"), "place", "turn_digest", "n"))
    return chained(rows, "part", "place"), convs


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op11_sql() -> str:
    digest = "sha256(concat(cast(length(role) AS VARCHAR), ':', role, text))"
    return f"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (SELECT conv_id, turn, text, {digest} AS digest FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS lead,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999]))),
      lambda crc, x: CASE WHEN x < 999 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, place, digest, text FROM c JOIN t ON t.conv_id = c.lead AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, digest, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h
), p AS (
  SELECT c.conv_id, coalesce(path, []::VARCHAR[]) AS path, coalesce(lens, []::BIGINT[]) AS lens
  FROM c LEFT JOIN (SELECT conv_id, list(digest ORDER BY part, place) AS path, list(length(text) ORDER BY part, place) AS lens FROM r GROUP BY conv_id) USING (conv_id)
), n AS (
  SELECT conv_id, d, path[1:d] AS pre, coalesce(lens[d], 0) AS len, len(path) = d AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)
), node AS (
  SELECT pre, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(len) AS len, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM n GROUP BY pre
), kids AS (
  SELECT pre[1:depth - 1] AS pre, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (pre)
), up AS (
  SELECT pre[1:k] AS pre, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * len) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_node) GROUP BY 1
)
SELECT f.conv_id, f.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_node f JOIN up USING (pre) LEFT JOIN node above ON f.depth > 0 AND above.pre = f.pre[1:f.depth - 1]
"""

"""The trie of conversations against a plain version."""

import hashlib
import random
import zlib

import pytest

from bagfold.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string"


def turn_key(r):
    said, by = r[3] or "", r[2] or ""
    return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(by)}:{by}{said}".encode()).digest())


def plain_turns(rows):
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return convs


def plain_rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(lead, [])[:h] + convs[c][h:]
    return out


def plain_trie(convs):
    members = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    n_children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            n_children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not n_children[k]
            saved[k[:d]] += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), n_children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()), key=str
    )


def conversations(draw):
    """Shared beginnings, copies, ties, nulls, absent first ones, short ones whose turns all go, negative ids."""
    rows = []
    said = [("user", "hello é"), ("assistant", "yes"), (None, None), ("user", ""), ("tool", "🙂 long " * 50)]
    for c in [*range(0, 40), *range(100, 130), 305, 306, 311, 399, -1, -100, -150, 700]:
        n = draw.choice([1, 1, 2, 3, 4, 8, 13])
        for t in range(n):
            by, text = draw.choice(said[:2]) if t < 3 else draw.choice(said)
            rows.append((c, draw.choice([t, t, t, t // 2, None]), by, text, 7, "clash"))
    rows += [(100, t, "user", f"turn {t}", 1, "x") for t in range(70)]
    rows += [rows[5], rows[5], (None, 1, "user", "of nobody", 0, "")]
    return rows


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_op11_equals_plain(spark, tables):
    rows = conversations(random.Random(3))
    folder = tables(conversations=spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = prefix_trie.op11_prefix_trie(spark, folder)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    convs = plain_turns(rows)
    assert collected(out) == plain_trie(plain_rebuilt(convs))
    assert any(not v for v in plain_rebuilt(convs).values())
    assert collected(prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))) == plain_trie(convs)


def test_one_conversation_over_all_ranges_and_a_hot_node(spark, monkeypatch):
    """A third of the rows are one conversation, another third copies of one that share a first turn; batches and pieces are small."""
    monkeypatch.setattr(prefix_trie, "HOT_ROWS", 20)
    monkeypatch.setattr(prefix_trie, "HOT_KEYS", 10)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = [(5, t, "user", f"t{t % 7}", 0, "") for t in range(900)] + [(1000 + c, t, "user", f"t{t}", 0, "") for c in range(300) for t in range(3)]
        rows += [(2000 + c, t, "user", "t0" if t == 0 else f"own {c} {t}", 0, "") for c in range(200) for t in range(4)]
        frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert collected(prefix_trie.prefix_trie(frame)) == plain_trie(plain_turns(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_fill_several_ranges(spark):
    rows = [(1, 0, "user", "same", 0, "")] * 500 + [(2, 0, "user", "same", 0, "")] * 3
    assert collected(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(plain_turns(rows))


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x", 0, "")], [(7, None, None, None, None, None)]])
def test_small_tables(spark, tables, rows):
    folder = tables(conversations=spark.createDataFrame(rows, SCHEMA))
    assert collected(prefix_trie.op11_prefix_trie(spark, folder)) == (plain_trie(plain_rebuilt(plain_turns(rows))) if rows and rows[0][0] else [])


def test_places_and_long_texts(spark):
    long = "é " * 200_000
    rows = [(1, 0, "user", long, 0, ""), (2, 0, "user", long, 0, ""), (2, 1, "user", "end", 0, "")]
    assert collected(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(plain_turns(rows))

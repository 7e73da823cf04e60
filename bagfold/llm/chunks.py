"""Memoised tokenisation of whole texts.

A byte-level BPE splits text by a pattern whose matches never run from a non-space into the white space behind it. So a
text may be cut before every white space that follows a non-space, and each chunk encoded apart and remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .kernel import binary_array, run_starts, span_hashes

#: Bytes of chunks and ids that a task remembers before it starts afresh, and what the objects of one chunk take besides.
MEMO_BYTES, CHUNK_BYTES = 64 << 20, 200


class ChunkMemo:
    """ids of texts as packed little-endian 32-bit numbers; ``encode`` does so for a list of chunks."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        import regex

        self.encode = encode
        self.spaced: dict[str, bytes] = {}  # without the one space in front
        self.plain: dict[str, bytes] = {"": b""}
        self.bytes = 0
        self.run = regex.compile(r"\s ")
        self.chunk = regex.compile(r"\s*\S+|\s+")

    def ids(self, texts: list[str]) -> list[bytes]:
        cut, spaced, plain = [], set(), set()
        for t in texts:
            if self.run.search(t) is None:
                parts = t.split(" ")
                cut.append((True, parts))
                plain.add(parts[0])
                spaced.update(parts[1:])
            else:
                parts = self.chunk.findall(t)
                cut.append((False, parts))
                plain.update(parts)
        if self.bytes > MEMO_BYTES:
            self.spaced, self.plain, self.bytes = {}, {"": b""}, 0
        for memo, wanted, front in ((self.spaced, spaced, " "), (self.plain, plain, "")):
            if new := list(wanted - memo.keys()):
                made = self.encode([front + x for x in new])
                memo.update(zip(new, made, strict=True))
                self.bytes += sum(map(len, new)) + sum(map(len, made)) + CHUNK_BYTES * len(new)
        at, first = self.spaced.__getitem__, self.plain.__getitem__
        return [b"".join([first(p[0]), *map(at, p[1:])]) if one else b"".join(map(first, p)) for one, p in cut]


#: Bytes behind which a space begins a chunk: none ends a white-space character (of the others in UTF-8 some do, too; a chunk may be longer).
SOLID = np.ones(256, bool)
SOLID[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
#: Chunks and ids that a task remembers before it starts afresh.
MEMO_CHUNKS, MEMO_IDS = 1 << 20, 1 << 23


class HashedMemo:
    """16-bit ids of the texts of a block, looked up by hashes of its chunks, of which 64 bits are kept.

    New chunks are encoded as one text; ``sizes``, the bytes of each id, tell where in its ids a chunk ends. ``describe`` says more of
    each of some chunks (bytes, offsets): columns of numbers, how many 64-bit keys it has, and these; that is remembered too.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], sizes: np.ndarray, describe: Callable[[np.ndarray, np.ndarray], tuple[list[np.ndarray], np.ndarray, np.ndarray]] | None = None):
        self.encode, self.sizes, self.describe = encode, sizes, describe
        self._forget()

    def _forget(self) -> None:
        """``keys`` are sorted, ``row`` tells where each stands in the columns, which grow at their ends."""
        self.keys, self.row, self.first, self.count, self.ids = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, "<u2"))
        self.more: list[np.ndarray] = []
        self.key_first, self.key_count, self.own_keys = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Append what is to be known of new chunks."""
        joined = (buf[start] == 32) & SOLID[buf[end - 1]]
        order = np.append(np.flatnonzero(joined), np.flatnonzero(~joined))
        n, start, end = int(joined.sum()), start[order], end[order]
        off = np.append(0, np.cumsum(end - start))
        text = buf[np.repeat(start - off[:-1], end - start) + np.arange(off[-1])]
        ids = self.encode(text[: off[n]].tobytes().decode())
        count = np.diff(np.searchsorted(np.cumsum(self.sizes[ids], dtype=np.int64), off[1 : n + 1], "right"), prepend=0)
        alone = [self.encode(text[s:e].tobytes().decode()) for s, e in zip(off[n:-1].tolist(), off[n + 1 :].tolist(), strict=True)]
        count = np.append(count, [len(x) for x in alone]).astype(np.int64)
        back = np.argsort(order)
        self.first = np.append(self.first, (len(self.ids) + np.cumsum(count) - count)[back])
        self.count = np.append(self.count, count[back])
        self.ids = np.concatenate([self.ids, *(x.astype("<u2") for x in (ids, *alone))])
        if self.describe is not None:
            more, many, keys = self.describe(text, off)
            self.more = [np.append(a, b[back]) for a, b in zip(self.more, more, strict=True)] if self.more else [b[back] for b in more]
            self.key_first = np.append(self.key_first, (len(self.own_keys) + np.cumsum(many) - many)[back])
            self.key_count, self.own_keys = np.append(self.key_count, many[back]), np.append(self.own_keys, keys)

    def find(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chunks of a block, all of them known then, and where each text begins among them."""
        begins = np.zeros(len(buf) + 1, bool)
        begins[1:-1] = (buf[1:] == 32) & SOLID[buf[:-1]]
        begins[off[:-1]] = True
        begins[-1] = False
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(buf))[: len(start)]
        h = span_hashes(buf, start, end).view(np.int64)
        order = np.argsort(h)
        key = h[order]
        lead = np.flatnonzero(run_starts(key))
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(h))))
        key, lead = key[lead], order[lead]
        if len(self.keys) > MEMO_CHUNKS or len(self.ids) > MEMO_IDS or len(self.own_keys) > MEMO_IDS // 4:
            self._forget()
        at = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != key
        if new.any():
            self.row = np.insert(self.row, at[new], len(self.count) + np.arange(int(new.sum())))
            self.keys = np.insert(self.keys, at[new], key[new])
            self._learn(buf, start[lead[new]], end[lead[new]])
            at += np.cumsum(new) - new  # as many keys came before
        return self.row[at][which], np.searchsorted(start, off)

    def packed(self, rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The packed ids of each text."""
        return _gathered(self.ids, self.first[rows], self.count[rows], bounds)

    def packed_keys(self, rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The packed keys of each text's chunks."""
        return _gathered(self.own_keys, self.key_first[rows], self.key_count[rows], bounds)

    def texts(self, buf: np.ndarray, off: np.ndarray) -> pa.Array:
        return self.packed(*self.find(buf, off))


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> pa.Array:
    to = np.append(0, np.cumsum(count))
    flat = values[np.repeat(first - to[:-1], count) + np.arange(to[-1])]
    return binary_array(flat.view(np.uint8), to[bounds] * values.itemsize)

"""A small causal self-attention model over subword ids, in NumPy.

One layer with one head: an id's row (frequent ids have their own, others share some) plus its place in the window goes through attention over
the places before it, and the sum of both gives a distribution over classes of ids. Frequent ids are classes of their own, the others are dealt into classes of about
equal mass; within a class, corpus counts (plus one) say how likely an id is. So every sequence of ids has a probability, and these
sum to one. Long sequences are cut into windows that overlap; each id is scored in one window only, with ``overlap`` ids or more before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

SHAPES = {"rows": ("slots", "width"), "places": ("window", "width"), "query": ("width", "width"), "key": ("width", "width"), "value": ("width", "width"), "mix": ("width", "width"), "out": ("width", "classes"), "bias": ("classes",)}


@dataclass(frozen=True)
class Shape:
    """``shared`` of the rows are shared by ids that have no row of their own; ``pooled`` of the classes hold several ids."""

    slots: int = 4096
    shared: int = 1024
    width: int = 16
    window: int = 32
    overlap: int = 8
    classes: int = 64
    pooled: int = 16


class Vocabulary:
    """Rows, classes and shares of ids from their counts; the last id ends a text and stands before its first."""

    def __init__(self, counts: np.ndarray, shape: Shape):
        n = len(counts)
        order = np.lexsort((np.arange(n), -counts))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        own = shape.slots - shape.shared
        self.slot = np.where(rank < own, rank, own + np.arange(n) % shape.shared).astype(np.int32)
        mass = counts.astype(np.float64) + 1
        single = shape.classes - shape.pooled
        before = np.cumsum(mass[order]) - mass[order]
        base = before[min(single, n - 1)]
        pooled = single + np.minimum((before - base) * shape.pooled // max(mass.sum() - base, 1.0), shape.pooled - 1)
        self.cls = np.empty(n, np.int32)
        self.cls[order] = np.where(np.arange(n) < single, np.arange(n), pooled)
        total = np.bincount(self.cls, mass, shape.classes)
        self.share = np.log10(mass / total[self.cls])
        self.bias = np.log(np.maximum(total, 1e-9) / mass.sum())
        self.end = n - 1


def start(shape: Shape, vocabulary: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """Before training the model is the unigram model of the ids: the output weights are zero, its bias is that of the counts."""
    draw = np.random.default_rng(seed)
    out = {k: draw.normal(0, 0.3 if k == "rows" else 0.1 if k == "places" else shape.width**-0.5, [getattr(shape, d) for d in dims]).astype(np.float32) for k, dims in SHAPES.items()}
    out["out"][:] = 0
    out["bias"] = vocabulary.bias.astype(np.float32)
    return out


def flatten(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def unflatten(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, dims in SHAPES.items():
        size = [getattr(shape, d) for d in dims]
        out[k] = flat[at : at + int(np.prod(size))].reshape(size).astype(np.float32)
        at += int(np.prod(size))
    return out


def windows(lengths: np.ndarray, shape: Shape, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of ``lengths``: sequence, first place, first place to score and number of places of each window. The last window of a long sequence is full."""
    size, step = shape.window, shape.window - (shape.overlap if overlap is None else overlap)
    count = np.where(lengths > size, 1 + -(-(lengths - size) // step), (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    room = np.maximum(lengths[doc] - size, 0)
    first = np.minimum(nth * step, room)
    skip = np.where(nth > 0, np.minimum((nth - 1) * step, room) + size - first, 0)
    return doc, first, skip, np.minimum(lengths[doc], size)


#: Logits are held under this, so that exponentials stay finite without a pass for the maximum.
MOST = np.float32(60)
_MASKS: dict[int, np.ndarray] = {}
_CELLS: dict[tuple[int, int], np.ndarray] = {}
#: Arrays that a process uses again in every step; new ones of this size would be mapped by the system each time.
_ROOM: dict[tuple[str, np.dtype], np.ndarray] = {}


def _later(n: int) -> np.ndarray:
    if n not in _MASKS:
        _MASKS[n] = np.tril(np.ones((n, n), np.float32))
    return _MASKS[n]


def _cells(rows: int, width: int) -> np.ndarray:
    """Places of the numbers of each row in the flat table."""
    if (rows, width) not in _CELLS:
        _CELLS[rows, width] = np.arange(rows * width).reshape(rows, width)
    return _CELLS[rows, width]


def _room(name: str, dims: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    size = math.prod(dims)
    have = _ROOM.get((name, dtype))
    if have is None or len(have) < size:
        have = _ROOM[name, dtype] = np.empty(size, dtype)
    return have[:size].reshape(dims)


def _shares(z: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the last axis (where ``mask`` is one) and their sums; z is overwritten."""
    if z.size and z.max() > MOST:
        np.minimum(z, MOST, out=z)
    np.exp(z, out=z)
    if mask is not None:
        z *= mask
    return z, (z.reshape(-1, z.shape[-1]) @ np.ones((z.shape[-1], 1), z.dtype)).reshape(*z.shape[:-1], 1)


def _folded(model: dict[str, np.ndarray]) -> np.ndarray:
    """Query with key, and value with mix, each pair as the one matrix that it amounts to, side by side."""
    scale = model["query"].dtype.type(len(model["query"]) ** -0.5)
    return np.concatenate([model["query"] @ model["key"].T * scale, model["value"] @ model["mix"]], 1)


def _attend(model: dict[str, np.ndarray], slots: np.ndarray, shape: Shape, first: int = 0):
    """The folded matrices, rows, their products with both, weights with their sums, what the places take over, and states with a one behind, of places from ``first`` on."""
    (n, w), d, kind = slots.shape, shape.width, model["rows"].dtype
    x = _room("x", (n, w, d), kind)
    model["rows"].take(slots.ravel(), 0, out=x.reshape(-1, d), mode="clip")
    x += model["places"]
    folded = _folded(model)
    y = np.matmul(x.reshape(-1, d), folded, out=_room("y", (n * w, 2 * d), kind)).reshape(n, w, 2 * d)
    e, total = _shares(np.matmul(y[:, first:, :d], x.transpose(0, 2, 1), out=_room("e", (n, w - first, w), kind)), _later(w)[first:])
    o = np.matmul(e, y[:, :, d:], out=_room("o", (n, w - first, d), kind))
    o /= total
    h = _room("h", (n, w - first, d + 1), kind)
    np.add(o, x[:, first:], out=h[..., :d])
    h[..., d] = 1
    return folded, x, y, e, total, o, h.reshape(-1, d + 1)


def _logits(model: dict[str, np.ndarray], h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states at ``place``, and what they say of each class."""
    if len(place) < len(h):
        h = h.take(place, 0)
    top = np.concatenate([model["out"], model["bias"][None]])
    return h, np.matmul(h, top, out=_room("z", (len(h), top.shape[1]), h.dtype))


def log_likelihood(model: dict[str, np.ndarray], slots: np.ndarray, classes: np.ndarray, scored: np.ndarray, shape: Shape) -> np.ndarray:
    """Natural logarithm of the class's probability at each of the ``scored`` places of windows (slots, classes: windows x window)."""
    used = scored.any(0)
    first = int(used.argmax()) if used.any() else 0
    place = np.flatnonzero(scored[:, first:])
    z = _logits(model, _attend(model, slots, shape, first)[-1], place)[1]
    own = np.minimum(z.ravel().take(np.arange(len(place)) * shape.classes + classes[:, first:].ravel().take(place)), MOST)
    return own - np.log(_shares(z)[1][:, 0])


def gradient(model: dict[str, np.ndarray], slots: np.ndarray, classes: np.ndarray, scored: np.ndarray, shape: Shape, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (natural logarithm; 0 if it isn't asked for) over the scored places, and its gradient."""
    folded, x, y, e, total, o, h = _attend(model, slots, shape)
    d, place, kind = shape.width, np.flatnonzero(scored), x.dtype
    weight = kind.type(1 / len(place))
    if 4 * len(place) >= 3 * len(h):  # the few other places go along with weight 0, which takes less than to leave them out
        place, weight = np.arange(len(h)), scored.reshape(-1, 1) * weight
    n = len(place)
    own, z = _logits(model, h, place)
    at = np.arange(n) * shape.classes + classes.ravel().take(place)
    logit = np.minimum(z.ravel().take(at), MOST)[:, None] if with_loss else None
    p, sums = _shares(z)
    loss = float(np.sum(weight * (np.log(sums) - logit), dtype=np.float64)) if with_loss else 0.0
    # the gradient by the logits is weight p / sums, less the weight at the own class: the rows' factors are left to the narrow sides of the products
    p.ravel()[at] -= sums[:, 0]
    each = weight / sums
    own *= each
    top = (p.T @ own).T  # the wide side first: BLAS takes it in less time
    out = {"out": top[:d], "bias": top[d]}
    back = np.matmul(p, model["out"].T, out=_room("back", (n, d), kind))
    back *= each
    dx = back
    if n < len(h):
        dx = _room("dx", (len(h), d), kind)
        dx[:] = 0
        dx[place] = back
    # the softmax's gradient: a (da - sum(a da)), whose sum is do . o
    do = np.divide(dx.reshape(o.shape), total, out=_room("do", o.shape, kind))
    g = _room("g", y.shape, kind)
    np.matmul(e.transpose(0, 2, 1), do, out=g[..., d:])
    ds = np.matmul(do, y[:, :, d:].transpose(0, 2, 1), out=_room("ds", e.shape, kind))
    do *= o
    ds -= (do.reshape(-1, d) @ np.ones((d, 1), kind)).reshape(total.shape)
    ds *= e
    np.matmul(ds, x, out=g[..., :d])
    dx += np.matmul(ds.transpose(0, 2, 1), y[:, :, :d], out=o).reshape(-1, d)
    g, xs = g.reshape(-1, 2 * d), x.reshape(-1, d)
    dx += np.matmul(g, folded.T, out=do.reshape(-1, d))
    by = (g.T @ xs).T
    pair, scale = by[:, :d], kind.type(d**-0.5)
    out["query"], out["key"] = pair @ model["key"] * scale, pair.T @ model["query"] * scale
    out["value"], out["mix"] = by[:, d:] @ model["mix"].T, model["value"].T @ by[:, d:]
    out["places"] = dx.reshape(x.shape).sum(0)
    where = _cells(shape.slots, d).take(slots.ravel(), 0, out=_room("where", (slots.size, d), np.dtype(np.int64)), mode="clip")
    wide = _room("wide", dx.shape, np.dtype(np.float64))
    wide[:] = dx
    out["rows"] = np.bincount(where.ravel(), wide.ravel(), shape.slots * d).reshape(-1, d).astype(kind)
    return loss, out


class Adam:
    """Steps on a model, whose arrays become parts of one flat array, so that a step is a few passes over all numbers."""

    def __init__(self, model: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.flat = flatten(model)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)  # sums that decay: 10 and 1000 times the means
        at = 0
        for k in SHAPES:
            model[k] = self.flat[at : at + model[k].size].reshape(model[k].shape)
            at += model[k].size

    def step(self, model: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t) * 0.1 / 0.001**0.5
        t = flatten(grad)
        self.m *= np.float32(0.9)
        self.m += t
        self.v *= np.float32(0.999)
        t *= t
        self.v += t
        np.sqrt(self.v, out=t)
        t += np.float32(1e-8 / 0.001**0.5)
        np.divide(self.m, t, out=t)
        t *= np.float32(rate)
        self.flat -= t

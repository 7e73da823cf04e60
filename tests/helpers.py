"""Plain NumPy versions for the tests."""

import numpy as np


def bits_of(vec, planes):
    return [int(x > 0) for x in vec.astype(float) @ planes.astype(float)]


def part_of(bits):
    """Most significant bit first; each bit is flipped if the number so far is odd."""
    out = 0
    for b in bits:
        out = 2 * out + (b ^ (out & 1))
    return out


def prefix_xor(n):
    out = 0
    while n:
        out ^= n
        n >>= 1
    return out


def encode_plain(bag, config, planes, project, reps, average, fill=False, inverse=False):
    """reps x buckets x width, and counts."""
    out = np.zeros((len(reps), config.buckets, config.width))
    counts = np.zeros((len(reps), config.buckets), int)
    for j, r in enumerate(reps):
        bits = [bits_of(v, planes(r)) for v in bag]
        for v, b in zip(bag, bits, strict=True):
            out[j, part_of(b)] += v.astype(float) @ project(r)
            counts[j, part_of(b)] += 1
        if average:
            out[j] /= np.maximum(counts[j], 1)[:, None]
            if fill and len(bag):
                for p in np.flatnonzero(counts[j] == 0).tolist():
                    aim = p ^ (p >> 1) if inverse else prefix_xor(p)
                    want = [(aim >> s) & 1 for s in range(config.bits - 1, -1, -1)]
                    far = [sum(x != y for x, y in zip(b, want, strict=True)) for b in bits]
                    out[j, p] = bag[int(np.argmin(far))].astype(float) @ project(r)
    return out, counts

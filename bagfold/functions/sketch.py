"""Column expressions: inner products, bucket numbers, distances, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, widened to double before it is summed."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def plane_bits(vec: Column, planes: Column) -> Column:
    """1 for each plane whose sketch is positive, else 0 (0 for a sketch of exactly 0)."""
    return F.transform(planes, lambda p: F.when(dot(vec, p) > 0, 1).otherwise(0))


def bits_value(bits: Column, first_is_high: bool = True) -> Column:
    """The bits as a number."""
    own = bits if first_is_high else F.reverse(bits)
    return F.aggregate(own, F.lit(0), lambda s, b: s * 2 + b)


def prefix_xor(n: Column, bits: int) -> Column:
    """n ^ n>>1 ^ n>>2 ^ ... : from Gray code to binary."""
    out = n
    for s in range(1, max(bits, 1)):
        out = out.bitwiseXOR(F.shiftright(n, s))
    return out


def gray(n: Column) -> Column:
    """n ^ n>>1 : from binary to Gray code."""
    return n.bitwiseXOR(F.shiftright(n, 1))


def bucket(vec: Column, planes: Column, bits: int) -> Column:
    """Bucket of a vector: the prefix XOR of its bits, the first plane highest."""
    return prefix_xor(bits_value(plane_bits(vec, planes)), bits).cast("int")


def alternative_label(vec: Column, planes: Column) -> Column:
    """Another one-to-one label of the same bits: the first plane lowest, then Gray code."""
    return gray(bits_value(plane_bits(vec, planes), first_is_high=False)).cast("int")


def bucket_distance(value: Column, part: Column, bits: int, inverse: bool = False) -> Column:
    """Bits in which a vector's number differs from what stands for bucket ``part``."""
    aim = gray(part) if inverse else prefix_xor(part, bits)
    return F.bit_count(value.bitwiseXOR(aim))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda an outer expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalised(v: Column, least: float = 1e-12) -> Column:
    """v over its norm, but not over less than ``least``."""
    return let(v, lambda w: scaled_by(w, F.lit(1.0) / F.greatest(norm(w), F.lit(least))))


def scaled_by(v: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(v, lambda x: x.cast("double") * f))


def times(v: Column, w: Column) -> Column:
    """Number by number."""
    return F.zip_with(v, w, lambda x, y: x.cast("double") * y.cast("double"))

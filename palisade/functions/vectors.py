"""Vectors as arrays of floats; sums run from left to right in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-4


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """The inner product. With the vectors' length it is one compiled expression; without, a fold. Null if lengths differ."""
    if dim is None:
        pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))
    total = F.lit(0.0)
    for i in range(dim):
        total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
    return F.when((F.size(a) == dim) & (F.size(b) == dim), total)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def sound(v: Column) -> Column:
    """Not null or empty, no null, NaN or infinity inside, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def normalize(v: Column, strict: bool = True) -> Column:
    """The vector at length 1, in float. With strict a vector that isn't sound is an error, else null."""
    unit = F.transform(v, lambda x: (x.cast("double") / magnitude(v)).cast("float"))
    bad = F.raise_error(F.lit("a vector is empty, zero or not finite")).cast("array<float>") if strict else F.lit(None).cast("array<float>")
    return F.when(sound(v), unit).otherwise(bad)


def cosine(a: Column, b: Column) -> Column:
    size = magnitude(a) * magnitude(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def is_normalized(v: Column) -> Column:
    return F.abs(magnitude(v) - 1) <= TOLERANCE


def int8_codes(v: Column) -> Column:
    """Components times 127, rounded half up, between -127 and 127."""
    return F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 127 + 0.5), F.lit(-127)), F.lit(127)).cast("tinyint"))


def int8_score(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def binary_codes(v: Column) -> Column:
    """Signs packed into words of 64 bits, the first component in the lowest bit of the first word."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))

    def word(i: Column) -> Column:
        bits = F.transform(F.slice(v, i * 64 + 1, F.lit(64)), lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(words, word)


def binary_score(a: Column, b: Column, dim: Column) -> Column:
    """How many of dim signs agree."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return dim - apart

"""Hashing and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start and multiplier of the hash.
START, FACTOR = 2166136261, 16777619
BITS = 4294967296


def compat_hash(word: Column, start: Column | None = None) -> Column:
    """32-bit hash whose product is rounded to a double before the high bits are dropped; characters up to U+FFFF.

    With ``start``, the hash of a text, it is that of the text with ``word`` after it.
    """
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        signed = F.when(x >= BITS // 2, x - BITS).otherwise(x)
        return F.pmod((signed.cast("double") * F.lit(float(FACTOR))).cast("long"), F.lit(BITS))

    return F.aggregate(codes, (F.lit(START) if start is None else start).cast("long"), step)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if lengths differ, a vector is empty or has norm 0."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (lengths > 0), dot(a, b) / lengths)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; a missing element counts as 0."""
    d = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))


def apply_signs(a: Column, signs: Column) -> Column:
    """``a`` with each element times its sign; a sign that is null or 0 counts as 1."""
    return F.zip_with(a, signs, lambda x, s: F.coalesce(x, F.lit(0.0)) * F.when(s < 0, -1.0).otherwise(1.0))


def diagonal(signs: Column) -> Column:
    """The matrix with ``signs`` on its diagonal."""
    return F.transform(signs, lambda s, i: F.transform(F.sequence(F.lit(0), F.size(signs) - 1), lambda j: F.when(i == j, s).otherwise(0)))


def rank_shift(a: Column, b: Column) -> Column:
    """Mean difference of rank over the features that both arrays have; null if they share none."""
    shared = F.array_intersect(a, b)
    total = F.aggregate(shared, F.lit(0).cast("long"), lambda s, f: s + F.abs(F.array_position(a, f) - F.array_position(b, f)))
    return F.when(F.size(shared) > 0, total / F.size(shared))

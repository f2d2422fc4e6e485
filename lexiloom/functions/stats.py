"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of k of n at 95 %; null for n = 0."""
    p, z2 = k / n, Z * Z
    mid, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))), F.when(n > 0, F.least(high, F.lit(1.0)))


def uniform(*key: Column | str) -> Column:
    """A number between 0 and 1 that a key alone decides; the same in any engine with md5."""
    text = F.md5(F.concat_ws("|", *key))
    return (F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def ranks(scores: Column) -> Column:
    """0-based positions by descending score, the first position first on a tie."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def argmax(scores: Column) -> Column:
    """0-based position of the largest score, the first on a tie."""
    return F.array_position(scores, F.array_max(scores)) - 1


def rank_consistency(a: Column, b: Column) -> Column:
    """Agreement of two rankings of n items: overlaps of their heads of each length, weighted by e^(n - j)."""
    n = F.size(a)
    at = F.sequence(F.lit(1), n)
    weight = F.aggregate(at, F.lit(0.0), lambda s, j: s + F.exp((n - j).cast("double")))
    total = F.aggregate(at, F.lit(0.0), lambda s, j: s + F.exp((n - j).cast("double")) * F.size(F.array_intersect(F.slice(a, 1, j), F.slice(b, 1, j))) / j)
    return total / weight


def entropy(p: Column) -> Column:
    """-sum of p ln p of an array of shares."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(x + F.lit(1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

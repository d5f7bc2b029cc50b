"""Column expressions over vectors: arrays of doubles, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / (norm(a) * norm(b)))


def entropy(p: Column) -> Column:
    """-sum p ln(p + 1e-12)."""
    return -total(F.transform(p, lambda x: x * F.log(x + F.lit(1e-12))))


def normalized_entropy(p: Column) -> Column:
    """Entropy over ln K; a single class keeps its entropy."""
    k = F.size(p)
    return F.when(k > 1, entropy(p) / F.log(k.cast("double"))).otherwise(entropy(p))


def ln_factorial(n: Column) -> Column:
    """ln n!: exact products to 20, beyond that Stirling's series, whose next term is below 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * 3.141592653589793 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)

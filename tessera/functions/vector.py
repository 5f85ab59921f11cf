"""Dense vectors in array columns, computed in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either side is null or lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Scaled to length 1; a zero or empty vector stays as it is."""
    d = a.cast("array<double>")
    # the length is bound to a lambda's variable, else it would be computed again for every element
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))
    return scaled[0]


def cosine(a: Column, unit: Column) -> Column:
    """Cosine of a vector with one of length 1; 0 for a zero vector, null for a null or wrongly sized one."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, dot(a, unit) / n).otherwise(n))[0]


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def clamp01(score: Column) -> Column:
    """Between 0 and 1; null stays null (``least`` alone would skip it)."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

"""Column expressions over ARRAY<FLOAT|DOUBLE> vectors (stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x)


def l2norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def normalise(a, eps: float = 0.0) -> Column:
    """Unit vector a / (|a| + eps) as ARRAY<DOUBLE>; a zero vector stays zero.

    The norm is computed once per row and zipped in as a repeated array: an
    outer expression referenced inside a lambda would be re-evaluated for
    every element (quadratic in the dimension).
    """
    a = _c(a)
    n = l2norm(a) + F.lit(eps)
    inv = F.when(n > 0, 1.0 / n).otherwise(F.lit(0.0))
    return F.zip_with(a, F.array_repeat(inv, F.size(a)), lambda x, y: x.cast("double") * y)


def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors; NULL where one is zero."""
    return F.try_divide(dot(a, b), l2norm(a) * l2norm(b))


def vsum(c) -> Column:
    """Element-wise sum aggregate of equal-length vectors, as ARRAY<DOUBLE>.

    Uses MLlib's `Summarizer` (a JVM aggregate with partial map-side merge),
    so a group of any size is reduced in streaming fashion, never collected.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return vector_to_array(Summarizer.sum(array_to_vector(_c(c))))

"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the norm of stored vectors, so that a zero vector stays one.
EPSILON = 1e-8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize_stored(a: Column) -> Column:
    n = norm(a) + EPSILON
    return F.transform(a, lambda x: x.cast("double") / n)


def normalize_query(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def similarity_from_distance(d: Column) -> Column:
    return 1 / (1 + d)


def distance_from_score(s: Column) -> Column:
    return 1 - s


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_second(a: Column, b: Column) -> Column:
    """The second of two softmax probabilities."""
    return 1 / (1 + F.exp(a - b))


def sanitize(a: Column) -> Column:
    """NaN becomes 0, the infinities 1 and -1."""
    inf = F.lit(float("inf")).cast("float")
    one = lambda x: F.when(F.isnan(x), F.lit(0.0)).when(x == inf, F.lit(1.0)).when(x == -inf, F.lit(-1.0)).otherwise(x).cast("float")
    return F.transform(a, one)


def is_finite(a: Column) -> Column:
    inf = F.lit(float("inf")).cast("float")
    return ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == inf))

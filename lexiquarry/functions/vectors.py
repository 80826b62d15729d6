"""Vector expressions over array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1], with 1e-8 added to each length."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))))


def l2_normalize(a: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    return bind(
        norm(a),
        lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
    )


def score_decay(distance: Column, scale: float = 10.0) -> Column:
    """Turn a distance into a similarity in (0, 1]."""
    return F.exp(-distance / F.lit(scale))

"""Vector arithmetic and score calibration as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import clamp


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`; inside a lambda a plain expression would run per element."""
    return F.transform(F.array(value), body)[0]


def unit(v: Column) -> Column:
    """v / |v|; null for a zero vector."""
    def scaled(s):
        return F.when(s["n"] > 0, F.transform(s["u"], lambda x: x.cast("double") / s["n"]))

    return _let(v, lambda u: _let(F.struct(u.alias("u"), l2_norm(u).alias("n")), scaled))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of equal-length vectors."""
    total = F.aggregate(
        F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))),
        F.transform(vectors[0], lambda x: x.cast("double")),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")),
    )
    n = F.size(vectors).cast("double")
    return F.transform(total, lambda x: x / n)


def ensemble(vectors: Column) -> Column:
    """Unit vectors averaged and normalised again."""
    return unit(mean_of(vectors))


def text_confidence(score: Column) -> Column:
    """Calibrated confidence of a text-to-tile score."""
    v = clamp((score - 0.15) / 0.18, 0.0, 1.0)
    return F.round(clamp(F.lit(0.5) + F.lit(0.48) * F.pow(v, F.lit(0.85)), 0.10, 0.99), 4)


def image_confidence(score: Column) -> Column:
    """Calibrated confidence of a tile-to-tile score."""
    v = clamp((score - 0.45) / 0.5, 0.0, 1.0)
    return F.round(F.lit(0.5) + F.lit(0.48) * v, 4)


def match_percentage(conf: Column) -> Column:
    return F.round(conf * 100, 1)

"""Per-pixel spectral indices and the season rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import clamp

EPS = 1e-6


def _ratio(a: Column, b: Column) -> Column:
    """(a-b)/(a+b+eps), clipped to [-1, 1]."""
    return clamp((a - b) / (a + b + F.lit(EPS)), -1.0, 1.0)


def ndvi(red: Column, green: Column, blue: Column, nir: Column) -> Column:
    gli = clamp((2.0 * green - red - blue) / (2.0 * green + red + blue + F.lit(EPS)), -1.0, 1.0)
    return F.when(nir.isNull(), gli).otherwise(_ratio(nir, red))


def ndwi(red: Column, green: Column, blue: Column, nir: Column) -> Column:
    return F.when(nir.isNull(), _ratio(blue, red)).otherwise(_ratio(green, nir))


def ndbi(red: Column, green: Column, blue: Column, nir: Column) -> Column:
    return F.when(nir.isNull(), _ratio(red, green)).otherwise(_ratio(red, nir))


def doy_distance(d1: Column, d2: Column) -> Column:
    """Circular day-of-year distance of two date strings; 0 when either cannot be read."""
    a = F.dayofyear(F.try_to_date(F.substring(d1.cast("string"), 1, 10), "yyyy-MM-dd"))
    b = F.dayofyear(F.try_to_date(F.substring(d2.cast("string"), 1, 10), "yyyy-MM-dd"))
    raw = F.abs(a - b)
    return F.coalesce(F.least(raw, F.lit(365) - raw), F.lit(0))


def season_penalty(d1: Column, d2: Column) -> Column:
    known = (
        F.try_to_date(F.substring(d1.cast("string"), 1, 10), "yyyy-MM-dd").isNotNull()
        & F.try_to_date(F.substring(d2.cast("string"), 1, 10), "yyyy-MM-dd").isNotNull()
    )
    dist = doy_distance(d1, d2)
    return (
        F.when(~known, F.lit(0.15))
        .when(dist < 30, F.lit(0.05))
        .when(dist < 75, F.lit(0.20))
        .when(dist < 140, F.lit(0.45))
        .otherwise(F.lit(0.70))
    )


def synthetic_nir(class_name: Column, red: Column, green: Column, blue: Column) -> Column:
    """Near-infrared estimated from the land-cover class."""
    from .. import vocab

    return F.floor(
        F.when(class_name.isin(*vocab.NIR_VEGETATION), clamp(green * 1.6 + 20, 0, 255))
        .when(class_name.isin(*vocab.NIR_WATER), clamp(blue * 0.15, 0, 45))
        .when(class_name.isin(*vocab.NIR_PAVED), clamp((red + green + blue) / 3.0 * 0.9, 0, 255))
        .otherwise(clamp(green * 1.1 + red * 0.4, 0, 255))
    ).cast("int")

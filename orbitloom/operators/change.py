"""Change decision and confidence on per-pair rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import spectral as S
from ..functions.common import clamp


def structural_score(mean_masked_diff: Column) -> Column:
    return F.coalesce(clamp((mean_masked_diff - 25.0) / 90.0, 0.0, 1.0), F.lit(0.0))


def driver(pixels: Column, dv: Column, dw: Column, db: Column) -> Column:
    """The first rule that fits."""
    return (
        F.when(pixels == 0, "none")
        .when((dw > 0.18) & (dv < -0.10), "water_inundation_or_flood")
        .when(dv < -0.22, "vegetation_loss_or_clearing")
        .when(dv > 0.22, "vegetation_greening")
        .when((db > 0.15) & (dv < -0.05), "urban_construction_or_expansion")
        .when((F.abs(dv) < 0.08) & (F.abs(dw) < 0.08) & (F.abs(db) < 0.08), "illumination_or_texture_shift")
        .otherwise("unclassified_structural")
    )


def confirmed(driver_name: Column) -> Column:
    return ~driver_name.isin("none", "illumination_or_texture_shift")


def description(driver_name: Column, dv: Column, dw: Column, db: Column) -> Column:
    two = lambda c: F.format_string("%.2f", c)
    t = vocab.DRIVER_TEXT
    args = {
        "water_inundation_or_flood": (dw, dv), "vegetation_loss_or_clearing": (dv,), "vegetation_greening": (dv,),
        "urban_construction_or_expansion": (db,),
    }
    out = None
    for name, text in t.items():
        val = F.format_string(text, *[two(a) for a in args[name]]) if name in args else F.lit(text)
        out = F.when(driver_name == name, val) if out is None else out.when(driver_name == name, val)
    return out


def spectral_score(pixels: Column, is_confirmed: Column) -> Column:
    return F.when(F.coalesce(pixels, F.lit(0)) == 0, 0.70).when(is_confirmed, 1.0).otherwise(0.35)


def seasonal_confound(ratio: Column, penalty: Column) -> Column:
    return F.when(ratio > 0.55, F.greatest(penalty, F.lit(0.75))).when(
        ratio > 0.30, F.greatest(penalty, F.lit(0.45))).otherwise(penalty)


def persistence(structural: Column) -> Column:
    return F.when(structural > 0.4, 0.80).otherwise(0.50)


def final_score(structural, spectral, registration, persist, seasonal, cloud) -> Column:
    w = vocab.CONFIDENCE_WEIGHTS
    raw = (structural * w["structural"] + spectral * w["spectral"] + registration * w["registration"]
           + persist * w["persistence"] + seasonal * w["seasonal"] + cloud * w["cloud"])
    return clamp(raw, 0.05, 0.98)


def score_label(score: Column) -> Column:
    return F.when(score >= 0.72, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def change_type(percentage: Column, score: Column) -> Column:
    return (
        F.when((percentage < 1.0) | (score < 0.3), F.lit(None).cast("string"))
        .when(percentage > 15, "major_change").when(percentage > 5, "moderate_change").otherwise("minor_change")
    )


def trust_gate(label: Column) -> Column:
    return F.when(label == "HIGH", "READY").when(label == "MEDIUM", "NEEDS REVIEW").otherwise("SUPPRESSED")


def changed_hectares(pixels: Column, gsd_metres: float = 10.0) -> Column:
    return F.round(pixels * (gsd_metres * gsd_metres) / 10000.0, 4)


def decide(df: DataFrame) -> DataFrame:
    """All decision columns from per-pair facts.

    Needs change_pixels, total_pixels, mean_masked_diff, delta_ndvi, delta_ndwi, delta_ndbi (unrounded, null
    without change), t1_date, t2_date, cloud1, cloud2, quality1, quality2, registration (null when unknown).
    A null total_pixels marks missing imagery and gives the error record.
    """
    ratio = F.when(F.col("total_pixels") > 0, F.col("change_pixels") / F.col("total_pixels")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumn("_ok", F.col("total_pixels").isNotNull()).withColumns({
        "change_pixels": F.coalesce("change_pixels", F.lit(0)), "total_pixels": F.coalesce("total_pixels", F.lit(0)),
    }).withColumns({"delta_ndvi": zero("delta_ndvi"), "delta_ndwi": zero("delta_ndwi"), "delta_ndbi": zero("delta_ndbi")})
    df = df.withColumn("_s", structural_score(F.col("mean_masked_diff"))).withColumn(
        "spectral_driver", driver(F.col("change_pixels"), F.col("delta_ndvi"), F.col("delta_ndwi"), F.col("delta_ndbi"))
    ).withColumns({
        "_p": spectral_score(F.col("change_pixels"), confirmed(F.col("spectral_driver"))),
        "_v": seasonal_confound(ratio, S.season_penalty(F.col("t1_date"), F.col("t2_date"))),
        "_k": F.greatest("cloud1", "cloud2"),
        "_r": F.coalesce("registration", F.least("quality1", "quality2")),
        "_t": persistence(F.col("_s")),
        "_pct": ratio * 100,
    }).withColumn("_f", final_score(*[F.col(c) for c in ("_s", "_p", "_r", "_t", "_v", "_k")]))
    ok = F.col("_ok")
    or_zero = lambda c: F.when(ok, F.round(c, 4)).otherwise(0.0)
    return df.withColumns({
        "structural": or_zero("_s"), "spectral_confirmation": or_zero("_p"), "seasonal_confound": or_zero("_v"),
        "cloud_contamination": or_zero("_k"), "registration_quality": or_zero("_r"), "persistence": or_zero("_t"),
        "final_score": or_zero("_f"),
        "doy_diff_days": F.when(ok, S.doy_distance(F.col("t1_date"), F.col("t2_date"))).otherwise(0),
        "label": F.when(ok, score_label(F.col("_f"))).otherwise("ERROR"),
        "change_percentage": F.round("_pct", 2),
        "change_type": F.when(ok, change_type(F.col("_pct"), F.round("_f", 4))),
        "status": F.when(ok, "completed").otherwise("error"),
        "spectral_description": F.when(F.col("change_pixels") > 0, description(
            F.col("spectral_driver"), F.col("delta_ndvi"), F.col("delta_ndwi"), F.col("delta_ndbi"))).otherwise(""),
        "spectral_driver": F.when(F.col("change_pixels") > 0, F.col("spectral_driver")).otherwise("structural"),
        "delta_ndvi": F.round("delta_ndvi", 4), "delta_ndwi": F.round("delta_ndwi", 4), "delta_ndbi": F.round("delta_ndbi", 4),
    }).drop("_ok", "_s", "_p", "_v", "_k", "_r", "_t", "_f", "_pct")

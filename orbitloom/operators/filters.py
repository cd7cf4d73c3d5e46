"""Row filters.  All are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.common import key_id


def bbox_overlap(minx, miny, maxx, maxy) -> Column:
    """Closed-interval overlap of row bounds with a box; rows without all four bounds never match."""
    return (
        (F.col("bounds_maxx") >= minx) & (F.col("bounds_minx") <= maxx)
        & (F.col("bounds_maxy") >= miny) & (F.col("bounds_miny") <= maxy)
    )


def metadata_filter(df: DataFrame, bbox=None, date_from=None, date_to=None, sensor=None, max_cloud=None) -> DataFrame:
    """Every given filter; an empty value means no filter.  Null dates and sensors never match."""
    if bbox and len(bbox) == 4:
        df = df.where(bbox_overlap(*[F.lit(float(v)) for v in bbox]))
    if date_from:
        df = df.where(F.col("acquisition_date") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.col("acquisition_date") <= F.lit(date_to).cast("date"))
    if sensor:
        df = df.where(F.lower("sensor") == sensor.lower())
    if max_cloud is not None:
        df = df.where(F.col("cloud_fraction") * 100 < float(max_cloud))
    return df


def in_keys(df: DataFrame, keys: DataFrame, key: str = "tile_id") -> DataFrame:
    """Rows whose key is listed.  The key list is reduced first, so a repeated key costs nothing."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def valid_pixels(pixels: DataFrame, tile: str = "tile_id", floor: float = 0.02) -> DataFrame:
    """Pixels brighter than the floor; a tile with none keeps all its pixels."""
    from pyspark.sql import Window

    bright = (F.col("red") + F.col("green") + F.col("blue")) / (3.0 * 255.0) > floor
    any_bright = F.max(bright.cast("int")).over(Window.partitionBy(tile))
    return pixels.withColumn("_ok", bright | (any_bright == 0)).where("_ok").drop("_ok")


def review_checks(reviews: DataFrame, analyses: DataFrame) -> DataFrame:
    """Reviews with a status: accepted, bad_decision or unknown_analysis."""
    known = analyses.select("analysis_id").distinct().withColumn("_known", F.lit(True))
    return reviews.join(known, "analysis_id", "left").withColumn(
        "status",
        F.when(~F.coalesce(F.col("decision").isin(*vocab.REVIEW_DECISIONS), F.lit(False)), "bad_decision")
        .when(F.col("_known").isNull(), "unknown_analysis")
        .otherwise("accepted"),
    ).drop("_known")


def search_checks(requests: DataFrame) -> DataFrame:
    """Search requests with a status: top_k must be 1..200 and given scores 0..1."""
    ok_k = F.coalesce(F.col("top_k").between(1, 200), F.lit(True))
    ok_s = F.coalesce(F.col("score").between(0.0, 1.0), F.lit(True))
    return requests.withColumn("status", F.when(~ok_k, "bad_top_k").when(~ok_s, "bad_score").otherwise("accepted"))


def accepted_reviews(reviews: DataFrame, analyses: DataFrame, stamp) -> DataFrame:
    """Rows to append to the review table: accepted reviews (analysis_id, decision, and tile_id, notes, analyst), each
    with an id of its natural key, so that a retried insert brings the same ids."""
    ok = review_checks(reviews, analyses).where("status = 'accepted'")
    return ok.select(
        key_id("rev-", F.col("analysis_id"), F.col("analyst"), F.col("decision")).alias("review_id"), F.col("analysis_id").cast("string").alias("analysis_id"),
        "tile_id", "decision", "notes", "analyst", F.lit(stamp).cast("timestamp").alias("created_at"),
    )

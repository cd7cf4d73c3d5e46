"""Scene ingestion: headers to scene rows, tile rows and a status per scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..operators import catalog as C, tiling as T
from ..session import materialize


def _checked(headers: DataFrame, sensor_override: str | None, date_override: str | None) -> DataFrame:
    """Headers with validity and scene id, a file that is listed twice once; `_first` marks the file that brings its
    scene into the archive, the first valid one by path."""
    # written once: the patterns of a file name are costly, and both sides of the join below read them
    checked = materialize(C.scene_metadata(C.validate_scenes(headers.dropDuplicates(["file_path"])), sensor_override, date_override), "checked")
    first = checked.where("valid").groupBy("scene_id").agg(F.min("file_path").alias("_first_path"))
    return checked.join(first, "scene_id", "left").withColumn("_first", F.col("valid") & (F.col("file_path") == F.col("_first_path"))).drop("_first_path")


def ingest_results(headers: DataFrame, known_scenes: DataFrame, sensor_override: str | None = None,
                   date_override: str | None = None) -> DataFrame:
    """(file_path, scene_id, status, message, tiles_created) per file: error, skipped (its scene is known, or an
    earlier file of the batch brings it) or success."""
    checked = _checked(headers, sensor_override, date_override)
    seen = known_scenes.select("scene_id").distinct().withColumn("_seen", F.lit(True))
    out = checked.join(seen, "scene_id", "left")
    status = F.when(~F.col("valid"), "error").when(F.col("_seen") | ~F.col("_first"), "skipped").otherwise("success")
    side = lambda c: F.greatest(F.lit(1), F.floor((F.col(c) - vocab.TILE_OVERLAP) / F.lit(vocab.TILE_SIZE - vocab.TILE_OVERLAP)))
    last = lambda c: F.col(c) - (side(c) - 1) * (vocab.TILE_SIZE - vocab.TILE_OVERLAP) >= vocab.TILE_SIZE // 2
    tiles = F.when(last("width") & last("height"), side("width") * side("height")).otherwise(0)
    return out.withColumn("status", status).select(
        "file_path", F.when(F.col("valid"), F.col("scene_id")).alias("scene_id"), "status",
        F.when(F.col("status") == "error", F.concat(F.lit("Validation failed: "), F.array_join("errors", "; ")))
        .when(F.col("status") == "skipped", F.format_string("Scene %s already exists in the archive", "scene_id"))
        .otherwise(F.format_string("Successfully ingested %s", "file_path")).alias("message"),
        F.when(F.col("status") == "success", tiles).otherwise(0).cast("bigint").alias("tiles_created"),
    )


def catalog_tables(headers: DataFrame, known_scenes: DataFrame, stamp, sensor_override: str | None = None,
                   date_override: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New scene rows and tile rows, ready to append; bounds and centers are in degrees, null (and flagged in
    `crs_status`) where the coordinate system is unsupported."""
    at = F.lit(stamp).cast("timestamp")
    fresh = _checked(headers, sensor_override, date_override).where("_first").join(
        known_scenes.select("scene_id").distinct(), "scene_id", "left_anti"
    )
    scenes = C.geographic_bounds(fresh).select(
        "scene_id", "file_path", "sensor", F.try_to_date("acquisition_date", "yyyy-MM-dd").alias("acquisition_date"), "crs",
        "bounds_minx", "bounds_miny", "bounds_maxx", "bounds_maxy", "width", "height", "band_count",
        at.alias("ingested_at"), F.lit(vocab.PROCESSING_VERSION).alias("processing_version"), "crs_status",
    )
    return scenes, T.tile_grid(fresh).withColumn("created_at", at)

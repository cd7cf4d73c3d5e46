"""Scene and tile catalog: validation, metadata, listings, counts, keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import naming as N, projection as P
from .ranking import one_row


def validate_scenes(headers: DataFrame) -> DataFrame:
    """Errors, warnings and validity per scene header (file_path, readable, crs, width, height, band_count).

    A header without a row of pixels (`present` false) reports only that; a wrong
    suffix or an unreadable file likewise.
    """
    sfx = N.suffix(F.col("file_path"))
    only = (
        F.when(~F.col("present"), F.lit("File not found"))
        .when(~sfx.isin(*vocab.RASTER_SUFFIXES), F.concat(F.lit("Unsupported format: "), sfx))
        .when(~F.col("readable"), F.lit("Cannot open raster"))
    )
    errors = F.array_compact(F.array(
        F.when(F.col("band_count") == 0, F.lit("No bands found in raster")),
        F.when((F.col("width") == 0) | (F.col("height") == 0), F.lit("Zero-dimension raster")),
    ))
    warnings = F.array_compact(F.array(
        F.when(F.col("crs").isNull(), F.lit("No CRS defined")),
        F.when(F.col("band_count").between(1, 2), F.format_string("Only %d band(s)", F.col("band_count"))),
    ))
    none = F.array().cast("array<string>")
    return (
        headers.withColumn("_only", only)
        .withColumn("errors", F.when(F.col("_only").isNotNull(), F.array("_only")).otherwise(errors))
        .withColumn("warnings", F.when(F.col("_only").isNotNull(), none).otherwise(warnings))
        .withColumn("valid", F.size("errors") == 0)
        .drop("_only")
    )


def scene_metadata(headers: DataFrame, sensor_override: str | None = None, date_override: str | None = None) -> DataFrame:
    """Sensor, date and scene id from the file name, after overrides (column names, may be null or empty)."""
    name = N.file_name(F.col("file_path"))
    given = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return (
        headers.withColumn("sensor", N.override(given(sensor_override), N.sensor_of(name)))
        .withColumn("acquisition_date", N.override(given(date_override), N.date_of(name)))
        .withColumn("scene_id", N.scene_id(F.col("file_path"), F.col("sensor"), F.col("acquisition_date")))
    )


def geographic_bounds(headers: DataFrame) -> DataFrame:
    """Bounds in degrees, corner by corner, and `crs_status`: EPSG:4326 and a missing system pass through, UTM
    zones are converted, bounds of other systems become null and are flagged `unsupported`."""
    minx, miny = P.to_degrees("crs", "bounds_minx", "bounds_miny")
    maxx, maxy = P.to_degrees("crs", "bounds_maxx", "bounds_maxy")
    return headers.withColumns({
        "bounds_minx": minx, "bounds_miny": miny, "bounds_maxx": maxx, "bounds_maxy": maxy, "crs_status": P.crs_status(F.col("crs")),
    })


def tiles_with_scenes(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Inner join on scene_id.  Spark sizes both sides: it broadcasts scenes only below its threshold, and
    adaptive execution splits a scene that holds much of the tile table."""
    return tiles.join(scenes.select("scene_id", "sensor", "acquisition_date"), "scene_id")


def list_tiles(tiles: DataFrame, scenes: DataFrame, scene_id: str | None = None, limit: int = 60) -> DataFrame:
    """The first `limit` tiles by id, with scene facts."""
    if scene_id:
        tiles = tiles.where(F.col("scene_id") == scene_id)
    return tiles_with_scenes(tiles, scenes).orderBy("tile_id").limit(limit)


def scene_listing(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every scene with its tile count (0 when it has none), newest ingest first.

    Tiles are counted before the join, so the join sees one row per scene.
    """
    counts = tiles.groupBy("scene_id").agg(F.count("*").alias("tile_count"))
    return (
        scenes.join(counts, "scene_id", "left")
        .withColumn("tile_count", F.coalesce("tile_count", F.lit(0)))
        .orderBy(F.col("ingested_at").desc(), "scene_id")
    )


def archive_stats(scenes: DataFrame, tiles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: table sizes, sensors seen, date range (null when no scene is dated)."""
    s = scenes.agg(
        F.count("*").alias("total_scenes"),
        F.array_join(F.array_sort(F.collect_set("sensor")), ",").alias("sensors"),
        F.min("acquisition_date").cast("string").alias("earliest"),
        F.max("acquisition_date").cast("string").alias("latest"),
    )
    t = tiles.agg(F.count("*").alias("total_tiles"))
    e = embeddings.agg(F.count("*").alias("total_embeddings"))
    return one_row(s, t, e)



def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Tiles indexed per (model, version)."""
    return manifest.groupBy("embedding_model", "embedding_version").agg(F.count("*").alias("indexed"))


def storage_footprint(files: DataFrame, length: str = "length") -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.sum(length).cast("bigint").alias("bytes"),
        F.round(F.sum(length) / 1048576.0, 2).alias("megabytes"),
    )


def ingest_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"),
        F.coalesce(F.sum("tiles_created"), F.lit(0)).cast("bigint").alias("tiles_created"),
    )


def latest_per_key(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key, as a mergeable maximum: a key repeated in most rows is reduced before the shuffle."""
    rest = [c for c in updates.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return updates.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*").select(*updates.columns)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Base rows whose key is not updated, plus the last update of each key."""
    last = latest_per_key(updates, keys, order)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_status(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Every new row with status `skipped` when its key exists, else `success`."""
    seen = existing.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return new.join(seen, keys, "left").withColumn(
        "status", F.when(F.col("_seen"), "skipped").otherwise("success")
    ).drop("_seen")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows plus new rows whose key is absent; a new key given twice is added once."""
    fresh = latest_per_key(new.join(existing.select(*keys), keys, "left_anti"), keys, order)
    return existing.unionByName(fresh.select(*existing.columns))

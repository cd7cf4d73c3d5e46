"""Two-date change analysis of many pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from functools import reduce

from .. import vocab
from ..functions import spectral as S
from ..functions.common import key_id
from ..operators import change as C, morphology as M, raster as R
from ..operators.ranking import date_ordered
from ..session import materialize


def matched_difference(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Paired pixels with matched t2 bands, difference, threshold and raw mask."""
    return R.threshold(R.difference(R.match_histograms(R.pair_pixels(t1, t2))))


def raw_mask(pixels: DataFrame) -> DataFrame:
    """Mask pixels with their image size: the input of morphology."""
    w = Window.partitionBy("pair_id")
    return pixels.withColumns({"height": F.max("row").over(w) + 1, "width": F.max("col").over(w) + 1}).where(
        F.col("raw_mask") == 1
    ).select("pair_id", "row", "col", "height", "width")


def final_mask(pixels: DataFrame) -> DataFrame:
    """Cleaned mask pixels in regions of at least the minimum area, with region labels."""
    return M.large_regions(M.regions(M.clean(raw_mask(pixels))))


def pair_facts(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Counts, masked difference, index deltas and both image qualities per pair, in one aggregate.

    The mask is partitioned like the pixels, so joining it back does not move them.
    """
    marked = pixels.join(mask.select("pair_id", "row", "col", "region").repartition("pair_id"), ["pair_id", "row", "col"], "left")
    one = lambda s: [F.col(b + s).cast("double") for b in R.BANDS]
    on = F.col("region").isNotNull()
    delta = lambda f: F.avg(F.when(on, f(*one("2")) - f(*one("1"))))
    return marked.groupBy("pair_id").agg(
        F.count("*").alias("total_pixels"), F.count_if(on).alias("change_pixels"),
        F.count_if(on & (F.col("row") * F.lit(1 << 20) + F.col("col") == F.col("region"))).alias("region_count"), F.first("threshold").alias("threshold"),
        F.avg(F.when(on, F.col("diff"))).alias("mean_masked_diff"),
        delta(S.ndvi).alias("delta_ndvi"), delta(S.ndwi).alias("delta_ndwi"), delta(S.ndbi).alias("delta_ndbi"),
        *[c for s in ("1", "2") for c in R.quality_aggregates([b + s for b in R.BANDS], s)],
    ).select(
        "pair_id", "total_pixels", "change_pixels", "region_count", "threshold", "mean_masked_diff", "delta_ndvi", "delta_ndwi", "delta_ndbi",
        *R.quality_columns("1"), *R.quality_columns("2"),
    )


def analyze_pairs(pairs: DataFrame, t1: DataFrame, t2: DataFrame) -> DataFrame:
    """One analysis row per listed pair (pair_id, tile_id, t1_tile_id, t2_tile_id, t1_date, t2_date).

    Pixels are keyed by pair_id.  A pair without common pixels gets the error record.
    """
    both = R.pair_pixels(t1, t2)
    pixels = R.threshold(R.difference(R.match_histograms(both)))
    facts = pair_facts(pixels, final_mask(pixels))
    shifts = M.shift_estimates(both).select(
        "pair_id", F.col("registration_quality").alias("registration"), F.col("total_shift_pixels").alias("registration_shift_px")
    )
    joined = pairs.join(facts, "pair_id", "left").join(shifts, "pair_id", "left").withColumnsRenamed({
        "cloud_fraction1": "cloud1", "cloud_fraction2": "cloud2", "overall_quality1": "quality1", "overall_quality2": "quality2",
    })
    return C.decide(joined).withColumn(
        "analysis_id", key_id("chg-", F.col("tile_id"), F.col("t1_tile_id"), F.col("t2_tile_id"))
    )


def change_shares(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """`pairs` (pair_id, t1_tile_id, t2_tile_id, ...) with `change_pct`, the cleaned change between both images in per cent (two
    decimals); null without common pixels.  `pixels` is keyed by tile_id."""
    image = lambda t: pixels.join(pairs.select("pair_id", F.col(t).alias("tile_id")), "tile_id").drop("tile_id")
    both = matched_difference(image("t1_tile_id"), image("t2_tile_id"))
    share = F.round(F.col("change_pixels") / F.col("total_pixels") * 100, 2).alias("change_pct")
    return pairs.join(pair_facts(both, final_mask(both)).select("pair_id", share), "pair_id", "left")


def earliest_supported_pixels(observations: DataFrame, pixels: DataFrame) -> DataFrame:
    """(site, observations, compared, run_length, earliest_supported): how far back the images of a site differ from its latest one.

    `observations`: site, obs_id (unique), tile_id, date; undated ones are left out.  `pixels`: tile_id, row, col and the bands; an
    observation without pixels is passed over.  The walk goes back from the latest observation (by date, then obs_id) and stops at the first
    image that has at most the threshold of changed pixels, or none in common with the latest.  The date is null with
    fewer than two observations or if the latest one has no image.

    Images are compared in rounds of 1, 2, 4, ... further steps back, only for sites whose compared images all differ.  So a
    site costs at most about twice the comparisons that its walk needs, and a history of n images takes log2(n) rounds,
    each a written table.
    """
    dated = observations.where("date IS NOT NULL AND site IS NOT NULL").select("site", "obs_id", "tile_id", "date")
    latest = dated.groupBy("site").agg(F.count("*").alias("observations"), F.max(F.struct("date", "obs_id", "tile_id")).alias("_last"))
    latest = materialize(latest, "latest")
    imaged = dated.join(pixels.select("tile_id").distinct(), "tile_id", "left_semi")
    lines = materialize(date_ordered(imaged, ["site"], "date", [F.col("obs_id")]), "lines")
    sizes = lines.groupBy("site").agg(F.count("*").alias("_images"))
    newest = lines.join(sizes, "site").where("position = _images").select("site", "obs_id", "_images")
    usable = latest.join(newest, "site").where("obs_id = _last.obs_id AND observations >= 2").select("site", "_last", "_images")
    steps = materialize(lines.join(usable, "site").where("position < _images").select(
        "site", "obs_id", "date", (F.col("_images") - F.col("position")).alias("back"), F.col("tile_id").alias("t1_tile_id"),
        F.col("_last.tile_id").alias("t2_tile_id"), F.sha2(F.concat_ws("|", "site", "obs_id"), 256).alias("pair_id")), "steps")

    differs = F.coalesce(F.col("change_pct") > vocab.SUPPORTED_CHANGE_PCT, F.lit(False))
    walking, rounds, first, width = None, [steps.limit(0).withColumn("change_pct", F.lit(None).cast("double"))], 1, 1
    while True:
        front = steps.where(F.col("back").between(first, first + width - 1))
        front = front if walking is None else front.join(walking, "site", "left_semi")
        if front.isEmpty():
            break
        shares = materialize(change_shares(front, pixels), "shares")
        rounds.append(shares)
        walking = shares.groupBy("site").agg(F.min(differs).alias("_all")).where("_all").select("site")
        first, width = first + width, width * 2
    seen = reduce(DataFrame.unionByName, rounds)
    stops = seen.groupBy("site").agg(F.count("*").alias("compared"), F.min(F.when(~differs, F.col("back"))).alias("_stop"))
    run = seen.join(stops, "site").where("_stop IS NULL OR back < _stop").groupBy("site").agg(F.count("*").alias("run_length"), F.min("date").alias("_first"))
    found = latest.join(stops, "site", "left").join(run, "site", "left").join(usable.select("site", F.lit(True).alias("_usable")), "site", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("site", "observations", none("compared"), none("run_length"),
                        F.when(F.col("_usable"), F.coalesce("_first", F.col("_last.date"))).alias("earliest_supported"))


def with_dates(pairs: DataFrame, tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs (t1_tile_id, t2_tile_id, t1_date, t2_date) with missing dates taken from the tiles' scenes; a date that is
    given stays, and a tile or scene that is not known leaves its date null."""
    dated = tiles.select("tile_id", "scene_id").join(scenes.select("scene_id", "acquisition_date"), "scene_id").select("tile_id", "acquisition_date")
    for side in ("t1", "t2"):
        found = dated.select(F.col("tile_id").alias(f"{side}_tile_id"), F.col("acquisition_date").alias("_found"))
        pairs = pairs.join(found, f"{side}_tile_id", "left").withColumn(f"{side}_date", F.coalesce(f"{side}_date", "_found")).drop("_found")
    return pairs


def analysis_records(analyses: DataFrame, stamp, earliest: DataFrame | None = None) -> DataFrame:
    """Rows for the change_analyses table; `earliest` is (tile_id, earliest_supported)."""
    df = analyses.where(F.col("status") == "completed")
    df = df.join(earliest, "tile_id", "left") if earliest is not None else df.withColumn("earliest_supported", F.lit(None).cast("string"))
    at = F.lit(stamp).cast("timestamp")
    return df.select(
        "analysis_id", "tile_id", "t1_tile_id", "t2_tile_id", "change_type", F.col("final_score").alias("confidence"),
        F.col("structural").alias("structural_confidence"), "seasonal_confound", "cloud_contamination", "registration_quality",
        F.col("persistence").alias("persistence_score"), F.col("earliest_supported").cast("string"),
        F.lit(None).cast("string").alias("change_mask_path"), "change_pixels", "total_pixels", "status",
        at.alias("created_at"), at.alias("completed_at"),
    )

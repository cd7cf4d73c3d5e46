"""Co-located observations over time.

Tiles of one place share its exact center, so everything here works on distinct
locations: a place photographed a million times is one row on the location side
of the range join, and what is emitted is (observation, nearby location), never
(tile, tile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.spectral import doy_distance
from .quadtree import ENDS, added_ends, latest_two, places_with_ends, window_ends
from .ranking import date_ordered

LOCATION = ["place"]


def place_of(lat: str = "center_lat", lon: str = "center_lon") -> Column:
    """Exact text key of a center; null without one.  Joins and aggregates on one text key share a partitioning,
    which float keys do not (each join normalises them anew)."""
    return F.concat((F.col(lat) + 0.0).cast("string"), F.lit(","), (F.col(lon) + 0.0).cast("string"))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def nearby_locations(tiles: DataFrame, degrees: float = vocab.COLOCATION_DEGREES, around: DataFrame | None = None) -> DataFrame:
    """(place, loc_lat, loc_lon) -> every distinct location (near_place, ...) within `degrees` (strict, per axis), itself included.
    `around` limits the left side to the locations of some tiles.

    A cell grid turns the range join into an equi-join: each location is looked up
    in its own and the eight adjacent cells, and the exact distance test stays.
    """
    def celled(df: DataFrame) -> DataFrame:
        locs = df.select(place_of().alias("place"), "center_lat", "center_lon").where(F.col("place").isNotNull()).groupBy("place").agg(
            F.first("center_lat").alias("loc_lat"), F.first("center_lon").alias("loc_lon")
        )
        return locs.select("*", _cell(F.col("loc_lat"), degrees).alias("_r"), _cell(F.col("loc_lon"), degrees).alias("_c"))

    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probes = (
        celled(tiles if around is None else around).withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
        .select("place", "loc_lat", "loc_lon", (F.col("_r") + F.col("_dr")).alias("_r"), (F.col("_c") + F.col("_dc")).alias("_c"))
    )
    other = celled(tiles).select(F.col("place").alias("near_place"), F.col("loc_lat").alias("near_lat"), F.col("loc_lon").alias("near_lon"), "_r", "_c")
    close = (F.abs(F.col("near_lat") - F.col("loc_lat")) < degrees) & (F.abs(F.col("near_lon") - F.col("loc_lon")) < degrees)
    return probes.join(other, ["_r", "_c"]).where(close).select("place", "loc_lat", "loc_lon", "near_place", "near_lat", "near_lon")


def _dated(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    return tiles.join(scenes.select("scene_id", "sensor", "acquisition_date"), "scene_id").where(
        F.col("acquisition_date").isNotNull() & F.col("center_lat").isNotNull() & F.col("center_lon").isNotNull()
    )


def location_observations(tiles: DataFrame, scenes: DataFrame, degrees: float = vocab.COLOCATION_DEGREES,
                          around: DataFrame | None = None) -> DataFrame:
    """Every dated observation near every distinct location (or near the locations of `around`)."""
    near = nearby_locations(tiles, degrees, around)
    obs = _dated(tiles, scenes).withColumn("near_place", place_of())
    return near.join(obs, "near_place").select(*LOCATION, "loc_lat", "loc_lon", "tile_id", "scene_id", "sensor", F.col("acquisition_date").alias("date"))


def timeline(observations: DataFrame) -> DataFrame:
    """Observations numbered by date within each location."""
    return date_ordered(observations, LOCATION, "date", [F.col("tile_id")])


def tile_timeline(tile_ids: DataFrame, tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Timelines of the asked tiles: the tile itself first among equal dates, an undated tile last.

    A tile without a center has the dated tiles whose boxes overlap its own instead of those around it.
    Output grows with the asked tiles only; the date order is computed per asked tile.
    """
    chosen = tiles.join(tile_ids.select("tile_id").distinct(), "tile_id", "left_semi")
    asked = chosen.join(scenes.select("scene_id", "acquisition_date", "sensor"), "scene_id").select(
        F.col("tile_id").alias("reference"), place_of().alias("place"), F.col("acquisition_date").alias("date"), "sensor",
    )
    obs = location_observations(tiles, scenes, around=chosen)
    others = asked.select("reference", *LOCATION).join(obs, LOCATION).where(F.col("reference") != F.col("tile_id")).select(
        "reference", "tile_id", "date", "sensor", F.lit(False).alias("is_reference")
    )
    by_box = footprint_overlaps(chosen.where(place_of().isNull()), tiles, scenes).select(
        "reference", "tile_id", "date", "sensor", F.lit(False).alias("is_reference"))
    own = asked.select("reference", F.col("reference").alias("tile_id"), "date", "sensor", F.lit(True).alias("is_reference"))
    return date_ordered(own.unionByName(others).unionByName(by_box), ["reference"], "date", [F.col("is_reference").desc(), F.col("tile_id")])


def _end_points(near: DataFrame, obs: DataFrame) -> DataFrame:
    """(place, n, lo, hi, hi2): count, earliest and latest two of the observations (near_place, o) at the places near each place.

    They are reduced at each exact place before the join, so a place with very many observations sends one row.
    """
    here = ["near_place"]
    at = obs.groupBy(*here).agg(F.count("*").alias("n"), F.min("o").alias("lo")).join(latest_two(obs, here), here)
    return added_ends(near.join(at, here).select(*LOCATION, *ENDS), LOCATION)


def best_pairs(tiles: DataFrame, scenes: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """First and last dated observation for every tile with at least two of them, or only for the tiles in
    `references` (reference), whose places alone are then searched.

    A tile goes first among equal dates, so the end points are kept per location
    (earliest one, latest two, by a tree of cells cut by their number of places) and resolved per tile; no timeline is built.  A tile without a center has the
    observations whose boxes overlap its own; its place is its box then.
    """
    dated = tiles.join(scenes.select("scene_id", "acquisition_date"), "scene_id").where(F.col("acquisition_date").isNotNull())
    moment = F.struct(F.col("acquisition_date").alias("date"), "tile_id").alias("o")
    refs = tiles.join(scenes.select("scene_id", "acquisition_date"), "scene_id").select(
        F.col("tile_id").alias("reference"), place_of().alias("center"), *BOX, F.col("acquisition_date").alias("_d"),
    )
    if references is not None:
        refs = refs.join(references.select("reference").distinct(), "reference", "left_semi")
    at = [place_of().alias("place"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")]
    asked = tiles if references is None else tiles.join(references.select(F.col("reference").alias("tile_id")), "tile_id", "left_semi")
    asked = asked.select(*at).where("place IS NOT NULL").groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    by_center = window_ends(asked, places_with_ends(dated.select(*at, moment).where("place IS NOT NULL")), vocab.COLOCATION_DEGREES)
    lost = refs.where("center IS NULL")
    boxes = overlapping_boxes(lost, dated).select(_box_key("a_").alias("place"), _box_key("b_").alias("near_place"))
    by_box = _end_points(boxes, dated.select(_box_key("bounds_").alias("near_place"), moment).where("near_place IS NOT NULL"))

    own_first = F.col("_d") == F.col("lo.date")
    shift = (F.col("hi.tile_id") == F.col("reference")) & (F.col("hi2.date") == F.col("hi.date"))
    placed = refs.withColumn("place", F.coalesce("center", _box_key("bounds_")))
    return placed.join(by_center.unionByName(by_box).where("n >= 2"), LOCATION).select(
        "reference", F.col("n").alias("observations"),
        F.when(own_first, F.col("reference")).otherwise(F.col("lo.tile_id")).alias("t1_tile_id"),
        F.col("lo.date").alias("t1_date"),
        F.when(shift, F.col("hi2.tile_id")).otherwise(F.col("hi.tile_id")).alias("t2_tile_id"),
        F.col("hi.date").alias("t2_date"),
    )


def chosen_pairs(requests: DataFrame, tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs for (reference, t1_tile_id, t2_tile_id) requests: both ids given and dated on the
    timeline are used as given (a missing one gives null); one id alone is ignored."""
    auto = best_pairs(tiles, scenes, requests).select(
        "reference", F.col("t1_tile_id").alias("_a1"), F.col("t2_tile_id").alias("_a2")
    )
    asked = requests.withColumn("_both", F.coalesce(F.col("t1_tile_id") != "", F.lit(False)) & F.coalesce(F.col("t2_tile_id") != "", F.lit(False)))
    lines = tile_timeline(requests.select(F.col("reference").alias("tile_id")), tiles, scenes).where(
        F.col("date").isNotNull()
    ).select("reference", F.col("tile_id").alias("_on"))
    found = (
        asked.join(lines, "reference", "left")
        .groupBy("reference", "t1_tile_id", "t2_tile_id", "_both")
        .agg(F.max(F.when(F.col("_on") == F.col("t1_tile_id"), F.col("_on"))).alias("_f1"),
             F.max(F.when(F.col("_on") == F.col("t2_tile_id"), F.col("_on"))).alias("_f2"))
        .join(auto, "reference", "left")
    )
    has_two = F.col("_a1").isNotNull()
    return found.select(
        "reference",
        F.when(has_two, F.when(F.col("_both"), F.col("_f1")).otherwise(F.col("_a1"))).alias("t1_tile_id"),
        F.when(has_two, F.when(F.col("_both"), F.col("_f2")).otherwise(F.col("_a2"))).alias("t2_tile_id"),
    )


BOX = ["bounds_minx", "bounds_miny", "bounds_maxx", "bounds_maxy"]
TOP_LEVEL = 14  # cells of 0.05 degrees doubled so often are wider than the globe


def _box_key(prefix: str) -> Column:
    """Exact text key of a box; null if a side is missing."""
    return F.concat(F.lit("box "), *[x for b in BOX for x in ((F.col(prefix + b[7:]) + 0.0).cast("string"), F.lit(","))])


def overlapping_boxes(left: DataFrame, right: DataFrame, cell: float = 0.05) -> DataFrame:
    """Distinct boxes of `left` (a_minx, ...) and `right` (b_minx, ...) that overlap, borders included.

    Cells double from level to level.  A box has the level at which a cell is at least as wide as the box: there it touches four
    cells at most, and as few at each level above, whatever its size.  Of two boxes the smaller one is looked up in the cells of the
    larger one's level: once from the left side, once from the right.  A pair is kept in the one cell that holds the
    lower-left corner of the intersection, so no de-duplication is needed.
    """
    def levelled(df: DataFrame, prefix: str, upwards: int | None) -> DataFrame:
        """Boxes in the cells of their own level, or of all levels from `upwards` above their own."""
        d = df.select(*[F.col(b).alias(prefix + b[7:]) for b in BOX]).dropna().distinct()
        lo, hi = (lambda x: F.col(prefix + "min" + x)), (lambda x: F.col(prefix + "max" + x))
        side = F.greatest(hi("x") - lo("x"), hi("y") - lo("y"))
        own = F.least(F.lit(TOP_LEVEL), F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(side / cell)), F.lit(0)))).cast("int")
        d = d.withColumn("level", own)
        if upwards is not None:
            d = d.where(F.col("level") + upwards <= TOP_LEVEL).withColumn("level", F.explode(F.sequence(F.col("level") + upwards, F.lit(TOP_LEVEL))))
        size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
        span = lambda x: F.explode(F.sequence(F.floor(F.least(lo(x), hi(x)) / size), F.floor(F.greatest(lo(x), hi(x)) / size)))
        return d.withColumn("_cx", span("x")).withColumn("_cy", span("y"))

    overlap = (
        (F.col("b_maxx") >= F.col("a_minx")) & (F.col("b_minx") <= F.col("a_maxx"))
        & (F.col("b_maxy") >= F.col("a_miny")) & (F.col("b_miny") <= F.col("a_maxy"))
    )
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    once = (F.floor(F.greatest("a_minx", "b_minx") / size) == F.col("_cx")) & (F.floor(F.greatest("a_miny", "b_miny") / size) == F.col("_cy"))
    met = lambda a, b: a.join(b, ["level", "_cx", "_cy"]).where(overlap & once).drop("level", "_cx", "_cy")
    return met(levelled(left, "a_", 0), levelled(right, "b_", None)).unionByName(met(levelled(left, "a_", None), levelled(right, "b_", 1)))


def footprint_overlaps(references: DataFrame, tiles: DataFrame, scenes: DataFrame, cell: float = 0.05, min_iou: float = 0.0) -> DataFrame:
    """Dated tiles whose box overlaps the reference box, by at least `min_iou` of their union; distinct footprints are matched."""
    pairs = overlapping_boxes(references, tiles, cell)
    inter = (F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx")) * (F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny"))
    area = lambda p: (F.col(p + "maxx") - F.col(p + "minx")) * (F.col(p + "maxy") - F.col(p + "miny"))
    shared = pairs.select(
        _box_key("a_").alias("a_key"), _box_key("b_").alias("b_key"), F.round(inter / (area("a_") + area("b_") - inter), 6).alias("iou"))
    if min_iou > 0:
        shared = shared.where(F.col("iou") >= min_iou)
    dated = tiles.join(scenes.select("scene_id", "sensor", "acquisition_date"), "scene_id").where(F.col("acquisition_date").isNotNull())
    found = dated.select("tile_id", F.col("acquisition_date").alias("date"), "sensor", _box_key("bounds_").alias("b_key"))
    asked = references.select(F.col("tile_id").alias("reference"), _box_key("bounds_").alias("a_key"))
    return asked.join(shared, "a_key").join(found, "b_key").where("reference <> tile_id").select("reference", "tile_id", "date", "sensor", "iou")


def nested_timeline(observations: DataFrame, site: list[str], chunk: int = 1000) -> DataFrame:
    """Timelines as arrays of structs, at most `chunk` observations per row, so no array grows without bound."""
    rows = date_ordered(observations, site, "date", [F.col("tile_id")])
    rows = rows.withColumn("chunk", F.floor((F.col("position") - 1) / F.lit(chunk)).cast("int"))
    entry = F.struct("position", F.col("date").cast("string").alias("date"), "tile_id", "sensor")
    return rows.groupBy(*site, "chunk").agg(F.sort_array(F.collect_list(entry)).alias("observations"))


def pair_counts(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Number of (earlier, later) tile pairs per grid position, from per-date counts; no pair is emitted."""
    daily = tiles.join(scenes.select("scene_id", "acquisition_date"), "scene_id").where(
        F.col("acquisition_date").isNotNull()
    ).groupBy("x_index", "y_index", "acquisition_date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("x_index", "y_index").orderBy("acquisition_date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).groupBy("x_index", "y_index").agg(
        F.sum(F.col("n") * F.col("before")).cast("bigint").alias("pairs")
    )


def pair_sample(tiles: DataFrame, scenes: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` (earlier, later) pairs on the same grid position, by (t1, t2) id.

    A tile has a partner exactly when its position holds a later date, so the first
    `limit` such tiles are enough; pairs are formed for those only.
    """
    dated = tiles.join(scenes.select("scene_id", "acquisition_date"), "scene_id").where(
        F.col("acquisition_date").isNotNull()
    ).select("tile_id", "scene_id", "x_index", "y_index", F.col("acquisition_date").alias("date"))
    latest = dated.groupBy("x_index", "y_index").agg(F.max("date").alias("_latest"))
    starts = (
        dated.join(latest, ["x_index", "y_index"]).where(F.col("date") < F.col("_latest"))
        .orderBy("tile_id").limit(limit)
        .select(F.col("tile_id").alias("t1_tile_id"), "x_index", "y_index", F.col("date").alias("t1_date"))
    )
    later = dated.select(F.col("tile_id").alias("t2_tile_id"), "x_index", "y_index", F.col("date").alias("t2_date"))
    return (
        later.join(F.broadcast(starts), ["x_index", "y_index"]).where(F.col("t1_date") < F.col("t2_date"))
        .select("t1_tile_id", "t2_tile_id", "t1_date", "t2_date").orderBy("t1_tile_id", "t2_tile_id").limit(limit)
    )


def same_season(pairs: DataFrame, days: int = 45) -> DataFrame:
    """Pairs whose day-of-year distance is below `days`."""
    return pairs.where(doy_distance(F.col("t1_date"), F.col("t2_date")) < days)


def earliest_supported(observations: DataFrame, site: str = "site") -> DataFrame:
    """Earliest date of the trailing run of observations that differ from the latest one.

    `observations`: site, obs_id, date, change_pct (against the latest), has_image.
    Walking back stops at the first observation at or below the threshold, so the
    answer is the earliest date after the last such observation: three mergeable
    aggregates instead of an ordered walk.  Null with fewer than two observations
    or when the latest has no image.
    """
    key = F.struct("date", "obs_id")
    last = observations.groupBy(site).agg(
        F.count("*").alias("_n"), F.max(F.struct("date", "obs_id", "has_image")).alias("_last")
    )
    earlier = observations.join(last, site).where(F.col("has_image") & (key < F.struct("_last.date", "_last.obs_id")))
    stop = earlier.groupBy(site).agg(
        F.max(F.when(~(F.coalesce("change_pct", F.lit(0.0)) > vocab.SUPPORTED_CHANGE_PCT), key)).alias("_stop")
    )
    run = (
        earlier.join(stop, site).where(F.col("_stop").isNull() | (key > F.col("_stop")))
        .groupBy(site).agg(F.min("date").alias("_first"), F.count("*").alias("_run"))
    )
    usable = (F.col("_n") >= 2) & F.col("_last.has_image")
    return last.join(run, site, "left").select(
        site, F.col("_n").alias("observations"), F.coalesce("_run", F.lit(0)).alias("run_length"),
        F.when(usable, F.coalesce("_first", F.col("_last.date"))).alias("earliest_supported"),
    )

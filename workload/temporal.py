"""Co-located observations and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitloom.operators import temporal as T

from . import views as v
from .duck_views import tile_name
from .registry import query

_DATED = """SELECT t.*, s.sensor, s.acquisition_date AS date FROM v_tiles t JOIN v_scenes s USING (scene_id) WHERE s.acquisition_date IS NOT NULL"""
_LOCS = "SELECT DISTINCT center_lat AS loc_lat, center_lon AS loc_lon FROM v_tiles"
_OBS = f"""SELECT l.loc_lat, l.loc_lon, o.tile_id, o.scene_id, o.sensor, o.date FROM ({_LOCS}) l JOIN ({_DATED}) o
  ON abs(o.center_lat - l.loc_lat) < 0.05 AND abs(o.center_lon - l.loc_lon) < 0.05"""


@query("J4 F8", f"SELECT loc_lat, loc_lon, tile_id, sensor, date::VARCHAR AS date FROM ({_OBS})")
def colocated_observations(spark, d):
    obs = T.location_observations(v.tiles(spark, d), v.scenes(spark, d))
    return obs.select("loc_lat", "loc_lon", "tile_id", "sensor", F.col("date").cast("string").alias("date"))


@query("W1", f"""
SELECT loc_lat, loc_lon, tile_id, date::VARCHAR AS date, row_number() OVER (PARTITION BY loc_lat, loc_lon ORDER BY date, tile_id) AS position FROM ({_OBS})""")
def location_timeline(spark, d):
    obs = T.location_observations(v.tiles(spark, d), v.scenes(spark, d))
    return T.timeline(obs).select("loc_lat", "loc_lon", "tile_id", F.col("date").cast("string").alias("date"), "position")


_TIMELINES = f"""
WITH asked AS (SELECT DISTINCT tile_id FROM v_queries WHERE tile_id IS NOT NULL),
refs AS (SELECT t.tile_id AS reference, center_lat, center_lon, s.acquisition_date AS date, s.sensor FROM v_tiles t JOIN asked USING (tile_id) JOIN v_scenes s USING (scene_id)),
lines AS (SELECT reference, reference AS tile_id, date, sensor, true AS is_reference FROM refs
  UNION ALL SELECT r.reference, o.tile_id, o.date, o.sensor, false FROM refs r JOIN ({_DATED}) o ON abs(o.center_lat - r.center_lat) < 0.05 AND abs(o.center_lon - r.center_lon) < 0.05 AND o.tile_id <> r.reference)"""


@query("W1 J4", _TIMELINES + """
SELECT reference, tile_id, date::VARCHAR AS date, is_reference, row_number() OVER (PARTITION BY reference ORDER BY date NULLS LAST, is_reference DESC, tile_id) AS position FROM lines""")
def asked_timelines(spark, d):
    asked = v.queries(spark, d).where("tile_id IS NOT NULL").select("tile_id")
    return T.tile_timeline(asked, v.tiles(spark, d), v.scenes(spark, d)).select(
        "reference", "tile_id", F.col("date").cast("string").alias("date"), "is_reference", "position"
    )


_BEST = f"""
WITH refs AS (SELECT t.tile_id AS reference, center_lat, center_lon, s.acquisition_date AS d FROM v_tiles t JOIN v_scenes s USING (scene_id)),
lines AS (SELECT reference, o.tile_id, o.date, o.tile_id = reference AS own FROM refs r JOIN ({_DATED}) o ON abs(o.center_lat - r.center_lat) < 0.05 AND abs(o.center_lon - r.center_lon) < 0.05),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY date, own DESC, tile_id) AS a, row_number() OVER (PARTITION BY reference ORDER BY date DESC, own, tile_id DESC) AS z,
  count(*) OVER (PARTITION BY reference) AS n FROM lines)
SELECT reference, max(n) AS observations, max(CASE WHEN a = 1 THEN tile_id END) AS t1_tile_id, max(CASE WHEN a = 1 THEN date::VARCHAR END) AS t1_date,
  max(CASE WHEN z = 1 THEN tile_id END) AS t2_tile_id, max(CASE WHEN z = 1 THEN date::VARCHAR END) AS t2_date FROM ranked WHERE n >= 2 GROUP BY 1"""


def _best(spark, d):
    return T.best_pairs(v.tiles(spark, d), v.scenes(spark, d))


@query("W2", _BEST)
def best_pairs(spark, d):
    return _best(spark, d).select(
        "reference", "observations", "t1_tile_id", F.col("t1_date").cast("string").alias("t1_date"), "t2_tile_id", F.col("t2_date").cast("string").alias("t2_date")
    )


@query("W2 C4", """
SELECT site, t1_date::VARCHAR AS t1_date, t2_date::VARCHAR AS t2_date FROM (SELECT site, min(date) AS t1_date, max(date) AS t2_date FROM v_obs GROUP BY 1 HAVING count(*) >= 2)
WHERE least(abs(dayofyear(t1_date) - dayofyear(t2_date)), 365 - abs(dayofyear(t1_date) - dayofyear(t2_date))) < 45""")
def same_season_pairs(spark, d):
    ends = v.observations(spark, d).groupBy("site").agg(F.min("date").alias("t1_date"), F.max("date").alias("t2_date"), F.count("*").alias("n"))
    return T.same_season(ends.where("n >= 2")).select("site", F.col("t1_date").cast("string").alias("t1_date"), F.col("t2_date").cast("string").alias("t2_date"))


@query("W2", _TIMELINES + f""",
req AS (SELECT tile_id AS reference, CASE WHEN vec_id % 3 = 0 THEN tile_id ELSE '' END AS t1_tile_id, CASE WHEN vec_id % 2 = 0 THEN {tile_name('(vec_id + 1)')} END AS t2_tile_id
  FROM v_tiles JOIN asked USING (tile_id)),
best AS ({_BEST.strip()})
SELECT q.reference,
  CASE WHEN b.reference IS NOT NULL THEN CASE WHEN q.t1_tile_id <> '' AND q.t2_tile_id <> '' THEN (SELECT max(tile_id) FROM lines l WHERE l.reference = q.reference AND l.tile_id = q.t1_tile_id AND date IS NOT NULL) ELSE b.t1_tile_id END END AS t1_tile_id,
  CASE WHEN b.reference IS NOT NULL THEN CASE WHEN q.t1_tile_id <> '' AND q.t2_tile_id <> '' THEN (SELECT max(tile_id) FROM lines l WHERE l.reference = q.reference AND l.tile_id = q.t2_tile_id AND date IS NOT NULL) ELSE b.t2_tile_id END END AS t2_tile_id
FROM req q LEFT JOIN best b ON q.reference = b.reference""")
def chosen_pairs(spark, d):
    asked = v.queries(spark, d).where("tile_id IS NOT NULL").select("tile_id").distinct()
    k = F.col("vec_id")
    req = v.tiles(spark, d).join(asked, "tile_id", "left_semi").select(
        F.col("tile_id").alias("reference"), F.when(k % 3 == 0, F.col("tile_id")).otherwise("").alias("t1_tile_id"),
        F.when(k % 2 == 0, v.tile_name(k + 1)).alias("t2_tile_id"),
    )
    return T.chosen_pairs(req, v.tiles(spark, d), v.scenes(spark, d))


@query("J5", f"""
SELECT r.tile_id AS reference, o.tile_id, o.date::VARCHAR AS date, round(w * h / (0.0008 - w * h), 4) AS iou
FROM v_tiles r JOIN ({_DATED}) o ON o.tile_id <> r.tile_id AND o.bounds_maxx >= r.bounds_minx AND o.bounds_minx <= r.bounds_maxx
  AND o.bounds_maxy >= r.bounds_miny AND o.bounds_miny <= r.bounds_maxy,
LATERAL (SELECT least(o.bounds_maxx, r.bounds_maxx) - greatest(o.bounds_minx, r.bounds_minx) AS w, least(o.bounds_maxy, r.bounds_maxy) - greatest(o.bounds_miny, r.bounds_miny) AS h)""")
def footprint_overlaps(spark, d):
    t = v.tiles(spark, d)
    out = T.footprint_overlaps(t, t, v.scenes(spark, d))
    return out.select("reference", "tile_id", F.col("date").cast("string").alias("date"), F.round("iou", 4).alias("iou"))


@query("J6", """
SELECT a.x_index, a.y_index, count(b.tile_id) AS pairs FROM (SELECT t.*, s.acquisition_date AS date FROM v_tiles t JOIN v_scenes s USING (scene_id) WHERE s.acquisition_date IS NOT NULL) a
LEFT JOIN (SELECT t.*, s.acquisition_date AS date FROM v_tiles t JOIN v_scenes s USING (scene_id)) b ON a.x_index = b.x_index AND a.y_index = b.y_index AND a.scene_id <> b.scene_id AND a.date < b.date GROUP BY 1, 2""")
def pair_counts(spark, d):
    return T.pair_counts(v.tiles(spark, d), v.scenes(spark, d))


@query("J6 L9", """
WITH t AS (SELECT 'tile_' || o_orderkey AS tile_id, o_orderstatus AS scene_id, o_custkey AS x, o_orderdate::DATE AS date FROM orders)
SELECT a.tile_id AS t1_tile_id, b.tile_id AS t2_tile_id, a.date::VARCHAR AS t1_date, b.date::VARCHAR AS t2_date FROM t a JOIN t b ON a.x = b.x AND a.date < b.date ORDER BY 1, 2 LIMIT 10""")
def pair_sample(spark, d):
    """Sites of the order table: one grid position per customer, a scene per date."""
    o = v.table(spark, d, "orders")
    scene = F.concat(F.lit("s_"), F.to_date("o_orderdate").cast("string"))
    t = o.select(F.concat(F.lit("tile_"), F.col("o_orderkey").cast("string")).alias("tile_id"), scene.alias("scene_id"),
                 F.col("o_custkey").alias("x_index"), F.lit(0).alias("y_index"))
    s = o.select(scene.alias("scene_id"), F.to_date("o_orderdate").alias("acquisition_date")).distinct()
    out = T.pair_sample(t, s)
    return out.select("t1_tile_id", "t2_tile_id", F.col("t1_date").cast("string").alias("t1_date"), F.col("t2_date").cast("string").alias("t2_date"))


@query("W3", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date DESC, obs_id DESC) AS back, count(*) OVER (PARTITION BY site) AS n FROM v_obs),
last AS (SELECT site, date AS last_date, has_image AS last_image, n FROM o WHERE back = 1),
walk AS (SELECT site, date, min(CASE WHEN change_pct > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY date DESC, obs_id DESC ROWS UNBOUNDED PRECEDING) AS still FROM o WHERE back > 1 AND has_image)
SELECT l.site, l.n AS observations, count(w.date) FILTER (w.still = 1) AS run_length,
  CASE WHEN l.n >= 2 AND l.last_image THEN coalesce(min(w.date) FILTER (w.still = 1), l.last_date)::VARCHAR END AS earliest_supported
FROM last l LEFT JOIN walk w ON l.site = w.site GROUP BY l.site, l.n, l.last_image, l.last_date""")
def earliest_supported(spark, d):
    return T.earliest_supported(v.observations(spark, d)).select(
        "site", "observations", "run_length", F.col("earliest_supported").cast("string").alias("earliest_supported")
    )


@query("W1", "SELECT site, obs_id, row_number() OVER (PARTITION BY site ORDER BY date, tile_id) AS position FROM v_obs")
def site_timeline(spark, d):
    from orbitloom.operators.ranking import date_ordered

    return date_ordered(v.observations(spark, d), ["site"], "date", [F.col("tile_id")]).select("site", "obs_id", "position")


@query("A12", """
SELECT site, ((position - 1) // 8)::INT AS chunk, string_agg(position || '@' || date || '@' || tile_id || '@' || sensor, ';' ORDER BY position) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date, tile_id) AS position FROM v_obs) GROUP BY 1, 2""")
def nested_timelines(spark, d):
    out = T.nested_timeline(v.observations(spark, d), ["site"], chunk=8)
    entry = F.transform("observations", lambda o: F.concat_ws("@", o["position"].cast("string"), o["date"], o["tile_id"], o["sensor"]))
    return out.select("site", "chunk", F.array_join(entry, ";").alias("line"))


# ---- tiles without a center: observations by overlapping boxes

_HOLED = """SELECT * REPLACE (CASE WHEN vec_id % 7 <> 0 THEN center_lat END AS center_lat, CASE WHEN vec_id % 7 <> 0 THEN center_lon END AS center_lon) FROM v_tiles"""
_SEEN = f"""
holed AS ({_HOLED}),
dated AS (SELECT t.*, s.sensor, s.acquisition_date AS date FROM holed t JOIN v_scenes s USING (scene_id) WHERE s.acquisition_date IS NOT NULL),
refs AS (SELECT t.*, s.acquisition_date AS date, s.sensor FROM holed t JOIN v_scenes s USING (scene_id)),
seen AS (SELECT r.tile_id AS reference, o.tile_id, o.date, o.sensor FROM refs r JOIN dated o ON abs(o.center_lat - r.center_lat) < 0.05 AND abs(o.center_lon - r.center_lon) < 0.05
  UNION ALL SELECT r.tile_id, o.tile_id, o.date, o.sensor FROM refs r JOIN dated o ON r.center_lat IS NULL AND o.bounds_maxx >= r.bounds_minx AND o.bounds_minx <= r.bounds_maxx
    AND o.bounds_maxy >= r.bounds_miny AND o.bounds_miny <= r.bounds_maxy)"""


def _holed(spark, d):
    """Every seventh tile has no center."""
    lost = F.col("vec_id") % 7 == 0
    return v.tiles(spark, d).withColumns({c: F.when(~lost, F.col(c)) for c in ("center_lat", "center_lon")})


@query("W1 J4 J5", f"""
WITH {_SEEN}, asked AS (SELECT tile_id FROM holed WHERE vec_id % 3 = 0),
lines AS (SELECT tile_id AS reference, tile_id, date, sensor, true AS is_reference FROM refs SEMI JOIN asked USING (tile_id)
  UNION ALL SELECT reference, tile_id, date, sensor, false FROM seen WHERE reference <> tile_id AND reference IN (SELECT tile_id FROM asked))
SELECT reference, tile_id, date::VARCHAR AS date, sensor, is_reference, row_number() OVER (PARTITION BY reference ORDER BY date NULLS LAST, is_reference DESC, tile_id) AS position FROM lines""")
def timelines_by_box(spark, d):
    """Timelines of every third tile; a seventh of all tiles has no center."""
    t = _holed(spark, d)
    return T.tile_timeline(t.where("vec_id % 3 = 0").select("tile_id"), t, v.scenes(spark, d)).select(
        "reference", "tile_id", F.col("date").cast("string").alias("date"), "sensor", "is_reference", "position")


@query("W2 J5", f"""
WITH {_SEEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY date, reference = tile_id DESC, tile_id) AS a,
  row_number() OVER (PARTITION BY reference ORDER BY date DESC, reference = tile_id, tile_id DESC) AS z, count(*) OVER (PARTITION BY reference) AS n FROM seen)
SELECT reference, max(n) AS observations, max(CASE WHEN a = 1 THEN tile_id END) AS t1_tile_id, max(CASE WHEN a = 1 THEN date::VARCHAR END) AS t1_date,
  max(CASE WHEN z = 1 THEN tile_id END) AS t2_tile_id, max(CASE WHEN z = 1 THEN date::VARCHAR END) AS t2_date FROM ranked WHERE n >= 2 GROUP BY 1""")
def best_pairs_by_box(spark, d):
    """First and last observation of every tile; a seventh of all tiles has no center."""
    return T.best_pairs(_holed(spark, d), v.scenes(spark, d)).select(
        "reference", "observations", "t1_tile_id", F.col("t1_date").cast("string").alias("t1_date"), "t2_tile_id", F.col("t2_date").cast("string").alias("t2_date"))


@query("J5", f"""
SELECT count(*) AS pairs, sum(CASE WHEN a.vec_id = b.vec_id THEN 1 ELSE 0 END)::BIGINT AS own
FROM (SELECT vec_id, bounds_minx - 0.01 * (vec_id % 50) ** 2 AS minx, bounds_maxx + 0.01 * (vec_id % 50) ** 2 AS maxx, bounds_miny, bounds_maxy FROM v_tiles WHERE vec_id % 20 = 0) a
JOIN v_tiles b ON b.bounds_maxx >= a.minx AND b.bounds_minx <= a.maxx AND b.bounds_maxy >= a.bounds_miny AND b.bounds_miny <= a.bounds_maxy""")
def wide_box_overlaps(spark, d):
    """Boxes of any width, up to that of a continent, against all tiles."""
    t = v.tiles(spark, d)
    more = F.lit(0.01) * F.pow(F.col("vec_id") % 50, F.lit(2.0))
    wide = t.where("vec_id % 20 = 0").withColumns({"bounds_minx": F.col("bounds_minx") - more, "bounds_maxx": F.col("bounds_maxx") + more})
    key = lambda df, p, name: df.select(F.col("vec_id").alias(name), *[F.col(b).alias(p + b[7:]) for b in T.BOX])
    sides = lambda p: [p + b[7:] for b in T.BOX]
    pairs = T.overlapping_boxes(wide, t).join(key(wide, "a_", "i"), sides("a_")).join(key(t, "b_", "j"), sides("b_"))
    return pairs.agg(F.count("*").alias("pairs"), F.sum((F.col("i") == F.col("j")).cast("long")).alias("own"))


@query("J4", """
WITH RECURSIVE nodes AS (SELECT scene_id, center_lat AS lat, center_lon AS lon, min(tile_id) AS node, count(*) AS n FROM v_tiles GROUP BY 1, 2, 3),
near AS (SELECT a.node, b.node AS other, b.n FROM nodes a JOIN nodes b ON a.scene_id = b.scene_id AND abs(a.lat - b.lat) < 0.05 AND abs(a.lon - b.lon) < 0.05),
core AS (SELECT node FROM near GROUP BY 1 HAVING sum(n) >= 4),
links AS (SELECT node, other FROM near WHERE node IN (FROM core) AND other IN (FROM core)),
reach(node, other) AS (SELECT node, node FROM core UNION SELECT r.node, l.other FROM reach r JOIN links l ON r.other = l.node),
named AS (SELECT node, min(other) AS cluster, 'core' AS role FROM reach GROUP BY 1),
border AS (SELECT n.node, min(c.cluster) AS cluster, 'border' AS role FROM near n JOIN named c ON n.other = c.node WHERE n.node NOT IN (FROM core) GROUP BY 1),
found AS (FROM named UNION ALL FROM border)
SELECT t.tile_id, coalesce(f.role, 'noise') AS role, f.cluster FROM v_tiles t JOIN nodes n ON t.scene_id = n.scene_id AND t.center_lat = n.lat AND t.center_lon = n.lon LEFT JOIN found f USING (node)""")
def scene_site_clusters(spark, d):
    """Density clusters of the places that each scene shows."""
    from orbitloom.operators.clusters import site_clusters

    return site_clusters(v.tiles(spark, d), ["scene_id"])


# ---- half of all tiles in one cell of 0.05 degrees, each at a center of its own

_CROWD = """SELECT * REPLACE (CASE WHEN vec_id % 2 = 0 THEN 10.001 + (vec_id * 7919 % 10007) / 10007.0::DOUBLE * 0.048 ELSE center_lat END AS center_lat,
  CASE WHEN vec_id % 2 = 0 THEN 20.001 + (vec_id * 104729 % 10009) / 10009.0::DOUBLE * 0.048 ELSE center_lon END AS center_lon) FROM v_tiles"""


@query("J4 W2", f"""
WITH crowd AS ({_CROWD}),
dated AS (SELECT t.*, s.acquisition_date AS date FROM crowd t JOIN v_scenes s USING (scene_id) WHERE s.acquisition_date IS NOT NULL),
lines AS (SELECT r.tile_id AS reference, o.tile_id, o.date, o.tile_id = r.tile_id AS own FROM crowd r JOIN dated o ON abs(o.center_lat - r.center_lat) < 0.05 AND abs(o.center_lon - r.center_lon) < 0.05),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY date, own DESC, tile_id) AS a, row_number() OVER (PARTITION BY reference ORDER BY date DESC, own, tile_id DESC) AS z,
  count(*) OVER (PARTITION BY reference) AS n FROM lines)
SELECT reference, max(n) AS observations, max(CASE WHEN a = 1 THEN tile_id END) AS t1_tile_id, max(CASE WHEN a = 1 THEN date::VARCHAR END) AS t1_date,
  max(CASE WHEN z = 1 THEN tile_id END) AS t2_tile_id, max(CASE WHEN z = 1 THEN date::VARCHAR END) AS t2_date FROM ranked WHERE n >= 2 GROUP BY 1""")
def best_pairs_in_crowd(spark, d):
    """First and last observation of every tile where every second tile lies in one crowded cell."""
    k, even = F.col("vec_id"), F.col("vec_id") % 2 == 0
    t = v.tiles(spark, d).withColumns({
        "center_lat": F.when(even, F.lit(10.001) + (k * 7919 % 10007) / F.lit(10007.0) * 0.048).otherwise(F.col("center_lat")),
        "center_lon": F.when(even, F.lit(20.001) + (k * 104729 % 10009) / F.lit(10009.0) * 0.048).otherwise(F.col("center_lon"))})
    return T.best_pairs(t, v.scenes(spark, d)).select(
        "reference", "observations", "t1_tile_id", F.col("t1_date").cast("string").alias("t1_date"), "t2_tile_id", F.col("t2_date").cast("string").alias("t2_date"))

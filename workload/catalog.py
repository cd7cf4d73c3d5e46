"""Sources, catalog, tiling, filters, audit, keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitloom.functions import naming as N
from orbitloom.functions.projection import utm_sql
from orbitloom.operators import audit as A, catalog as C, filters as FL, tiling as T
from orbitloom.sources import tables as S

from . import views as v
from .duck_views import tile_name
from .registry import query


@query("M1", r"""
SELECT header_key, err = '' AS valid, err AS errors, warn AS warnings FROM (
SELECT header_key, CASE WHEN NOT present THEN 'File not found'
    WHEN suffix NOT IN ('.tif', '.tiff', '.geotiff') THEN 'Unsupported format: ' || suffix
    WHEN NOT readable THEN 'Cannot open raster'
    ELSE concat_ws('; ', CASE WHEN band_count = 0 THEN 'No bands found in raster' END,
      CASE WHEN width = 0 OR height = 0 THEN 'Zero-dimension raster' END) END AS err,
  CASE WHEN NOT present OR suffix NOT IN ('.tif', '.tiff', '.geotiff') OR NOT readable THEN ''
    ELSE concat_ws('; ', CASE WHEN crs IS NULL THEN 'No CRS defined' END,
      CASE WHEN band_count BETWEEN 1 AND 2 THEN 'Only ' || band_count || ' band(s)' END) END AS warn
FROM v_named)""")
def scene_validation(spark, d):
    return C.validate_scenes(v.headers(spark, d)).select(
        "header_key", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")
    )


@query("M2 M3 M4 M5 M6", "SELECT header_key, scene_id, sensor, acquisition_date FROM v_scene_ids")
def scene_metadata(spark, d):
    return C.scene_metadata(v.headers(spark, d), "sensor_given", "date_given").select(
        "header_key", "scene_id", "sensor", "acquisition_date"
    )


_ZONE = "CAST(substring(crs, 9, 2) AS DOUBLE)"


def _degrees(east: str, north: str) -> tuple[str, str]:
    """Longitude and latitude of a header's point, in SQL."""
    lon, lat = utm_sql(east, north, _ZONE, "crs LIKE 'EPSG:327%'")
    pick = lambda plain, sql: f"CASE WHEN crs IS NULL OR crs = 'EPSG:4326' THEN {plain} WHEN crs LIKE 'EPSG:32%' THEN {sql} END"
    return pick(east, lon), pick(north, lat)


@query("M15", f"""
SELECT header_key, round({_degrees('bounds_minx', 'bounds_miny')[0]}, 6) AS bounds_minx, round({_degrees('bounds_minx', 'bounds_miny')[1]}, 6) AS bounds_miny,
  round({_degrees('bounds_maxx', 'bounds_maxy')[0]}, 6) AS bounds_maxx, round({_degrees('bounds_maxx', 'bounds_maxy')[1]}, 6) AS bounds_maxy,
  CASE WHEN crs IS NULL OR crs = 'EPSG:4326' THEN 'degrees' WHEN crs LIKE 'EPSG:32%' THEN 'utm' ELSE 'unsupported' END AS crs_status FROM v_headers""")
def scene_bounds(spark, d):
    bounds = ["bounds_minx", "bounds_miny", "bounds_maxx", "bounds_maxy"]
    return C.geographic_bounds(v.headers(spark, d)).select("header_key", *[F.round(c, 6).alias(c) for c in bounds], "crs_status")


def _grid_scenes(spark, d):
    ok = C.validate_scenes(v.headers(spark, d)).where("valid")
    return C.scene_metadata(ok, "sensor_given", "date_given")


_VALID = """present AND suffix IN ('.tif', '.tiff', '.geotiff') AND readable AND band_count > 0 AND width > 0 AND height > 0"""


def _grid_sql(cols: str, rows: str, size: int, step: int, where: str) -> str:
    (minx, miny), (maxx, maxy), (cx, cy) = _degrees("tx0", "ty0"), _degrees("tx1", "ty1"), _degrees("((tx0 + tx1) / 2)", "((ty0 + ty1) / 2)")
    return f"""
SELECT scene_id || '_x' || lpad(xi::VARCHAR, 2, '0') || '_y' || lpad(yi::VARCHAR, 2, '0') AS tile_id, xi AS x_index, yi AS y_index,
  win_w AS win_width, win_h AS win_height, round({minx}, 6) AS minx, round({maxx}, 6) AS maxx,
  round({maxy}, 6) AS maxy, round({miny}, 6) AS miny, round({cx}, 6) AS center_lon, round({cy}, 6) AS center_lat
FROM (SELECT *, bounds_minx + xi * {step} * xr AS tx0, bounds_minx + (xi * {step} + win_w) * xr AS tx1,
    bounds_maxy - yi * {step} * yr AS ty1, bounds_maxy - (yi * {step} + win_h) * yr AS ty0
  FROM (SELECT *, least({size}, width - xi * {step})::INT AS win_w, least({size}, height - yi * {step})::INT AS win_h,
      (bounds_maxx - bounds_minx) / width AS xr, (bounds_maxy - bounds_miny) / height AS yr
    FROM (SELECT *, unnest(generate_series(0, n_cols - 1))::INT AS xi FROM
      (SELECT *, unnest(generate_series(0, n_rows - 1))::INT AS yi FROM
        (SELECT *, {cols} AS n_cols, {rows} AS n_rows FROM v_scene_ids WHERE {_VALID} {where})))))
WHERE win_w >= {size // 2} AND win_h >= {size // 2}"""


def _grid_out(df):
    r = lambda c, a: F.round(c, 6).alias(a)
    return df.select(
        "tile_id", "x_index", "y_index", "win_width", "win_height", r("bounds_minx", "minx"), r("bounds_maxx", "maxx"),
        r("bounds_miny", "miny"), r("bounds_maxy", "maxy"), r("center_lon", "center_lon"), r("center_lat", "center_lat"),
    )


@query("M7 M8 M9 M10", _grid_sql("greatest(1, (width - 32) // 224)", "greatest(1, (height - 32) // 224)", 256, 224, ""))
def tile_grid(spark, d):
    return _grid_out(T.tile_grid(_grid_scenes(spark, d)))


@query("M12", _grid_sql("width // 256", "height // 256", 256, 256, "AND width >= 256 AND height >= 256"))
def tile_grid_plain(spark, d):
    return _grid_out(T.tile_grid_plain(_grid_scenes(spark, d)))


def _scene_pixels(spark, d):
    p = v.pixels(spark, d).withColumn("scene_id", F.concat(F.lit("px_"), F.lpad(F.floor(F.col("tile") / 4).cast("string"), 6, "0")))
    return p.select("scene_id", (F.col("row") + 32 * F.floor((F.col("tile") % 4) / 2)).cast("int").alias("row"),
                    (F.col("col") + 32 * (F.col("tile") % 2)).cast("int").alias("col"), "red", "green", "blue", "nir")


_SCENE_PX = """SELECT 'px_' || lpad((tile // 4)::VARCHAR, 6, '0') AS scene_id, row + 32 * ((tile % 4) // 2) AS r, col + 32 * (tile % 2) AS c,
  red, green, blue, nir FROM v_pixels"""


@query("M13", f"""
WITH px AS ({_SCENE_PX}), sized AS (SELECT scene_id, max(c) + 1 AS w, max(r) + 1 AS h FROM px GROUP BY 1),
grid AS (SELECT *, unnest(generate_series(0, greatest(1, (w - 8) // 16) - 1)) AS xi FROM
  (SELECT *, unnest(generate_series(0, greatest(1, (h - 8) // 16) - 1)) AS yi FROM sized))
SELECT scene_id || '_x' || lpad(xi::VARCHAR, 2, '0') || '_y' || lpad(yi::VARCHAR, 2, '0') AS tile_id,
  (r - yi * 16)::INT AS row, (c - xi * 16)::INT AS col, red, nir
FROM px JOIN grid USING (scene_id)
WHERE c >= xi * 16 AND c < xi * 16 + 24 AND r >= yi * 16 AND r < yi * 16 + 24
  AND least(24, w - xi * 16) >= 12 AND least(24, h - yi * 16) >= 12""")
def pixel_tiles(spark, d):
    px = _scene_pixels(spark, d)
    dims = px.groupBy("scene_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    return T.pixels_to_tiles(px, dims, 24, 8).select("tile_id", "row", "col", "red", "nir")


@query("M11", """
SELECT t.tile_id, r.i::INT AS row, c.i::INT AS col, coalesce(p.red, 0) AS red, coalesce(p.green, 0) AS green, coalesce(p.blue, 0) AS blue, coalesce(p.nir, 0) AS nir
FROM (SELECT DISTINCT tile_id FROM v_pixels) t, range(40) r(i), range(40) c(i)
LEFT JOIN v_pixels p ON p.tile_id = t.tile_id AND p.row = r.i AND p.col = c.i""")
def padded_tiles(spark, d):
    return T.zero_padded(v.pixels(spark, d), 40)


@query("M14", "SELECT tile_id, content_hash FROM v_current")
def content_hashes(spark, d):
    from orbitloom.operators.incremental import content_hash

    docs = v.table(spark, d, "documents")
    return content_hash(docs, "text").select(F.col("doc_id").cast("string").alias("tile_id"), "content_hash")


_INGESTED = f"""
files AS (SELECT *, '/again/' || substr(file_path, 6) AS path FROM v_scene_ids UNION ALL SELECT *, file_path FROM v_scene_ids),
known AS (SELECT scene_id FROM v_scene_ids WHERE header_key % 5 = 0 AND {_VALID}),
judged AS (SELECT path AS file_path, CASE WHEN {_VALID} THEN scene_id END AS scene_id, CASE WHEN NOT ({_VALID}) THEN 'error'
    WHEN scene_id IN (SELECT scene_id FROM known) OR row_number() OVER (PARTITION BY scene_id, {_VALID} ORDER BY path) > 1 THEN 'skipped' ELSE 'success' END AS status FROM files),
n AS (SELECT regexp_replace(tile_id, '_x[0-9]+_y[0-9]+$', '') AS sid, count(*) AS tiles FROM ({_grid_sql("greatest(1, (width - 32) // 224)", "greatest(1, (height - 32) // 224)", 256, 224, "")}) GROUP BY 1),
results AS (SELECT j.*, CASE WHEN status = 'success' THEN coalesce(tiles, 0) ELSE 0 END::BIGINT AS tiles_created FROM judged j LEFT JOIN n ON j.scene_id = n.sid)"""


def _ingested(spark, d):
    """Every header twice, under two paths, into an archive that knows a part of the scenes."""
    from orbitloom.plans.ingest import ingest_results

    h = v.headers(spark, d)
    again = h.withColumn("file_path", F.concat(F.lit("/again/"), F.substring("file_path", 6, 10_000)))
    known = C.scene_metadata(C.validate_scenes(h.where("header_key % 5 = 0")).where("valid"), "sensor_given", "date_given")
    return ingest_results(h.unionByName(again), known, "sensor_given", "date_given")


@query("M16 S12", f"WITH {_INGESTED} SELECT file_path, scene_id, status, tiles_created FROM results")
def ingest_results(spark, d):
    return _ingested(spark, d).select("file_path", "scene_id", "status", "tiles_created")


@query("M16", f"""
WITH {_INGESTED} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, coalesce(sum(tiles_created), 0)::BIGINT AS tiles_created FROM results""")
def ingest_summary(spark, d):
    return C.ingest_summary(_ingested(spark, d))


# ---- filters

@query("F1", """SELECT tile_id FROM v_tiles WHERE bounds_maxx >= 91.6 AND bounds_minx <= 91.8 AND bounds_maxy >= 26.1 AND bounds_miny <= 26.3""")
def bbox_filter(spark, d):
    return FL.metadata_filter(v.tiles(spark, d), bbox=[91.6, 26.1, 91.8, 26.3]).select("tile_id")


@query("F2 F3 F4 F5 J1", """
SELECT tile_id, sensor, acquisition_date::VARCHAR AS acquisition_date FROM v_tiles JOIN v_scenes USING (scene_id)
WHERE bounds_maxx >= 91.6 AND bounds_minx <= 91.95 AND bounds_maxy >= 26.0 AND bounds_miny <= 26.5
  AND acquisition_date >= DATE '2024-02-14' AND acquisition_date <= DATE '2024-08-12' AND lower(sensor) = 'landsat-8'""")
def combined_filters(spark, d):
    df = C.tiles_with_scenes(v.tiles(spark, d), v.scenes(spark, d))
    return FL.metadata_filter(df, [91.6, 26.0, 91.95, 26.5], "2024-02-14", "2024-08-12", "LANDSAT-8").select(
        "tile_id", "sensor", F.col("acquisition_date").cast("string").alias("acquisition_date")
    )


@query("F7 J13", """
SELECT tile_id, scene_id FROM v_tiles WHERE tile_id IN (SELECT tile_id FROM v_queries WHERE tile_id IS NOT NULL)""")
def tiles_in_key_list(spark, d):
    return FL.in_keys(v.tiles(spark, d), v.queries(spark, d)).select("tile_id", "scene_id")


@query("F9", """
SELECT tile_id, count(*) AS kept FROM (SELECT tile_id, (red + green + blue) / (3.0::DOUBLE * 255.0::DOUBLE) > 0.02 AS ok,
  max(CASE WHEN (red + green + blue) / (3.0::DOUBLE * 255.0::DOUBLE) > 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY tile_id) AS anyok FROM v_pixels)
WHERE ok OR anyok = 0 GROUP BY 1""")
def valid_pixel_counts(spark, d):
    return FL.valid_pixels(v.pixels(spark, d)).groupBy("tile_id").agg(F.count("*").alias("kept"))


@query("F10 C13", """
SELECT r.analysis_id, decision, CASE WHEN decision NOT IN ('confirmed', 'rejected', 'uncertain') THEN 'bad_decision'
  WHEN k.doc_id IS NULL THEN 'unknown_analysis' ELSE 'accepted' END AS status
FROM (SELECT analysis_id * 2 AS analysis_id, decision FROM v_reviews) r LEFT JOIN documents k ON r.analysis_id = k.doc_id""")
def review_status(spark, d):
    """Reviews of every second id: those beyond the last document are unknown."""
    known = v.table(spark, d, "documents").select(F.col("doc_id").alias("analysis_id"))
    reviews = v.reviews(spark, d).withColumn("analysis_id", F.col("analysis_id") * 2)
    return FL.review_checks(reviews, known).select("analysis_id", "decision", "status")


@query("F10", """
SELECT o_orderkey AS request, CASE WHEN NOT (o_orderkey % 260 BETWEEN 1 AND 200) THEN 'bad_top_k'
  WHEN NOT (o_totalprice / 400000.0::DOUBLE BETWEEN 0 AND 1) THEN 'bad_score' ELSE 'accepted' END AS status FROM orders""")
def request_status(spark, d):
    o = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 260).alias("top_k"), (F.col("o_totalprice") / 400000.0).alias("score")
    )
    return FL.search_checks(o).select("request", "status")


# ---- catalog listings and counts

@query("A1 U4", """
SELECT (SELECT count(*) FROM v_scenes) AS total_scenes, (SELECT string_agg(DISTINCT sensor, ',' ORDER BY sensor) FROM v_scenes) AS sensors,
  (SELECT min(acquisition_date)::VARCHAR FROM v_scenes) AS earliest, (SELECT max(acquisition_date)::VARCHAR FROM v_scenes) AS latest,
  (SELECT count(*) FROM v_tiles) AS total_tiles, (SELECT count(*) FROM embeddings) AS total_embeddings""")
def archive_stats(spark, d):
    return C.archive_stats(v.scenes(spark, d), v.tiles(spark, d), v.table(spark, d, "embeddings"))


@query("A2", "SELECT embedding_model, embedding_version, count(*) AS indexed FROM v_manifest GROUP BY 1, 2")
def manifest_stats(spark, d):
    return C.manifest_stats(v.manifest(spark, d))


@query("J2 A3 L4", """
SELECT s.scene_id, ingested_on::VARCHAR AS ingested_on, count(t.tile_id) AS tile_count
FROM (SELECT scene_id, ingested_on FROM v_scenes UNION ALL SELECT 'scene_' || r_name, DATE '2024-07-01' FROM region) s LEFT JOIN v_tiles t ON s.scene_id = t.scene_id
GROUP BY 1, 2 ORDER BY ingested_on DESC, s.scene_id""")
def scene_listing(spark, d):
    """All scenes, and one per region that has no tiles yet."""
    bare = v.table(spark, d, "region").select(F.concat(F.lit("scene_"), "r_name").alias("scene_id"), F.to_timestamp(F.lit("2024-07-01 00:00:00")).alias("ingested_at"))
    scenes = v.scenes(spark, d).select("scene_id", "ingested_at").unionByName(bare)
    return C.scene_listing(scenes, v.tiles(spark, d)).select(
        "scene_id", F.to_date("ingested_at").cast("string").alias("ingested_on"), "tile_count"
    )


@query("L1 J1", """
SELECT tile_id, scene_id, sensor FROM v_tiles JOIN v_scenes USING (scene_id) WHERE scene_id = 'scene_2_URBAN_INDUSTRIAL_HUB' ORDER BY tile_id LIMIT 60""")
def tile_listing(spark, d):
    return C.list_tiles(v.tiles(spark, d), v.scenes(spark, d), "scene_2_URBAN_INDUSTRIAL_HUB").select("tile_id", "scene_id", "sensor")


@query("A11", """
SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1048576.0::DOUBLE, 2) AS megabytes FROM documents""")
def storage_footprint(spark, d):
    files = v.table(spark, d, "documents").select(F.octet_length("text").cast("bigint").alias("length"))
    return C.storage_footprint(files)


@query("S2", "SELECT tile_id, scene_id FROM v_tiles")
def tile_scan(spark, d):
    return v.tiles(spark, d).select("tile_id", "scene_id").orderBy("tile_id")


@query("S14", "SELECT tile_id, scene_id, sensor FROM v_tiles JOIN v_scenes USING (scene_id) WHERE tile_id = 'tile_00042'")
def tile_lookup(spark, d):
    return C.tiles_with_scenes(S.lookup(v.tiles(spark, d), "tile_id", "tile_00042"), v.scenes(spark, d)).select("tile_id", "scene_id", "sensor")


# ---- keyed writes

@query("S11 U5", """
WITH upd AS (SELECT o_custkey AS k, max_by({'s': o_orderstatus, 'p': o_totalprice}, (o_orderdate, o_orderkey)) AS r FROM orders GROUP BY 1)
SELECT c_custkey AS site, 'base' AS origin, c_acctbal AS amount FROM customer WHERE c_custkey NOT IN (SELECT k FROM upd)
UNION ALL SELECT k, r.s, r.p FROM upd""")
def keyed_upsert(spark, d):
    base = v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("site"), F.lit("base").alias("origin"), F.col("c_acctbal").alias("amount"),
        F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("seq"),
    )
    upd = v.table(spark, d, "orders").select(
        F.col("o_custkey").alias("site"), F.col("o_orderstatus").alias("origin"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"),
    )
    return C.upsert(base, upd, ["site"], ["at", "seq"]).select("site", "origin", "amount")


@query("S12 V11", """
SELECT o_custkey AS site, o_orderkey AS seq, CASE WHEN c_custkey IS NULL THEN 'success' ELSE 'skipped' END AS status
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def insert_status(spark, d):
    seen = v.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("site"))
    new = v.table(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("seq"))
    return C.insert_status(new, seen, ["site"]).select("site", "seq", "status")


@query("V11 S12", """
SELECT c_custkey AS site, 0 AS seq FROM customer WHERE c_acctbal > 0
UNION ALL SELECT o_custkey, max(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def insert_absent(spark, d):
    have = v.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("site"), F.lit(0).cast("bigint").alias("seq"))
    new = v.table(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("seq"))
    return C.insert_absent(have, new, ["site"], ["seq"])


# ---- relevance sets

@query("S4", """
SELECT j.query_id, tile_id, relevant, relevant_count, non_relevant_count FROM (
  SELECT lang AS query_id, doc_id::VARCHAR AS tile_id, max(quality) AS relevant FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) j
JOIN (SELECT lang AS query_id, count(*) FILTER (quality = 1) AS relevant_count, count(*) FILTER (quality <> 1) AS non_relevant_count
  FROM (SELECT lang, doc_id, max(quality) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) GROUP BY 1) USING (query_id)""")
def relevance_sets(spark, d):
    """Judgments written as a CSV file and read back as sets, with every member."""
    from orbitloom.session import new_table_path

    j = v.table(spark, d, "labels").join(v.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(
        F.col("lang").alias("query_id"), F.col("lang").alias("query"), F.col("doc_id").cast("string").alias("tile_id"), F.col("quality").alias("relevant")
    )
    path = new_table_path(spark, "relevance")
    j.write.option("header", True).csv(path)
    once, sizes = S.relevance_sets(S.read_relevance(spark, path))
    return once.select("query_id", "tile_id", "relevant").join(sizes.drop("query"), "query_id").select(
        "query_id", "tile_id", "relevant", "relevant_count", "non_relevant_count")


# ---- audit

@query("A14 A9", """
SELECT query_type, count(*) AS n, round(avg(latency_ms), 4) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95
FROM v_query_log GROUP BY 1""")
def latency_by_type(spark, d):
    return A.latency_by(v.query_log(spark, d), ["query_type"]).select(
        "query_type", "n", F.round("mean", 4).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")
    )


@query("A9", """
SELECT count(*) AS n, round(avg(latency_ms), 2) AS mean, round(quantile_cont(latency_ms, 0.5), 2) AS p50, round(quantile_cont(latency_ms, 0.95), 2) AS p95 FROM v_query_log""")
def latency_overall(spark, d):
    return A.latency_by(v.query_log(spark, d), []).select("n", *[F.round(c, 2).alias(c) for c in ("mean", "p50", "p95")])


@query("A14", """
SELECT query_type, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS queries, round(avg(latency_ms), 6) AS mean_latency_ms
FROM v_query_log GROUP BY ROLLUP (query_type, day)""")
def latency_rollup(spark, d):
    return A.latency_rollup(v.query_log(spark, d)).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query("A15", """
SELECT analysis_id, count(*) FILTER (decision = 'confirmed') AS confirmed, count(*) FILTER (decision = 'rejected') AS rejected,
  count(*) FILTER (decision = 'uncertain') AS uncertain FROM v_reviews GROUP BY 1""")
def review_tallies(spark, d):
    return A.review_tallies(v.reviews(spark, d))


@query("L2", "SELECT provenance_id, entity_type FROM v_provenance ORDER BY created_at DESC, provenance_id LIMIT 50")
def recent_provenance(spark, d):
    return A.recent(v.provenance(spark, d)).select("provenance_id", "entity_type")


@query("L3", "SELECT provenance_id, entity_id FROM v_provenance WHERE entity_type = 'click' ORDER BY created_at DESC")
def provenance_by_entity(spark, d):
    return A.by_entity(v.provenance(spark, d), "click").select("provenance_id", "entity_id")


@query("S10", """
SELECT 'q-' || sha256(query_id) AS query_id, query_type, filters FROM (
SELECT query_id, query_type, '{"bbox":null,"date_from":null,"date_to":"' || strftime(created_at, '%Y-%m-%d') || '","sensor":"' || query_type || '"}' AS filters FROM v_query_log)""")
def query_log_rows(spark, d):
    log = v.query_log(spark, d).select(
        F.col("query_id").alias("query_key"), "query_type", F.lit(None).cast("string").alias("query_text"),
        F.lit(None).cast("string").alias("query_tile_id"), F.lit(None).cast("array<double>").alias("bbox"),
        F.lit(None).cast("string").alias("date_from"), F.date_format("created_at", "yyyy-MM-dd").alias("date_to"),
        F.col("query_type").alias("sensor"), F.lit(0).alias("result_count"), "latency_ms", "created_at",
    )
    return A.query_log_rows(log).select("query_id", "query_type", "filters")


@query("S10", """
SELECT 'prov-' || sha256(entity_type || '|' || entity_id || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS provenance_id,
  entity_id, '{"k":' || json_extract_string(parameters, '$.k') || '}' AS parameters, '0.1.0' AS processing_version FROM v_provenance""")
def provenance_rows(spark, d):
    p = v.provenance(spark, d)
    none = F.lit(None).cast("string")
    return A.provenance_rows(p.select(
        "entity_type", "entity_id", none.alias("query_text"), none.alias("query_tile_id"), "embedding_model",
        none.alias("embedding_version"), F.from_json("parameters", "k INT").alias("parameters"),
        F.struct(F.col("confidence").alias("top")).alias("result_summary"), "confidence",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )).select("provenance_id", "entity_id", "parameters", "processing_version")


@query("S10", """
SELECT query_id, CASE WHEN event_id % 5 = 0 THEN 'broken ' || filters ELSE json_extract_string(filters, '$.k') END AS k FROM v_query_log""")
def tolerant_json(spark, d):
    log = v.query_log(spark, d).withColumn("filters", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("broken "), "filters")).otherwise(F.col("filters")))
    return A.tolerant_json(log, "filters", "k", "k").select("query_id", "k")


@query("S10", """
SELECT provenance_id, '{"@context":"http://www.w3.org/ns/prov#","@type":"Activity","@id":"' || provenance_id || '","type":"' || entity_type || '","generated":"' ||
  entity_id || '","used":"hashing-words","endedAtTime":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS jsonld FROM v_provenance""")
def provenance_jsonld(spark, d):
    return A.provenance_jsonld(v.provenance(spark, d))


@query("S8", r"""
SELECT file_path AS path, regexp_extract(file_path, '([^/]+)/[^/]+$', 1) AS class_name, regexp_extract(file_path, '([^/]+)/[^/]+$', 1) || '_' || stem AS tile_id FROM v_named""")
def class_folder_names(spark, d):
    p = F.col("file_path")
    return v.headers(spark, d).select(p.alias("path"), N.parent_folder(p).alias("class_name"), F.concat_ws("_", N.parent_folder(p), N.stem(p)).alias("tile_id"))


@query("V12", """
WITH t AS (SELECT 'h' || header_key AS tile_id, file_path, header_key % 6 AS k FROM v_headers),
tried AS (SELECT tile_id, unnest(['data/public/' || file_path, 'data/public/tiles/' || tile_id || '.png', 'data/public/tiles/' || tile_id || '.jpg', file_path]) AS path, unnest([1, 3, 4, 0]) AS o, unnest([1, 2, 3, 4]) AS f, k FROM t)
SELECT t.tile_id, min_by(x.path, x.o) AS found_path FROM t LEFT JOIN tried x ON x.tile_id = t.tile_id AND (x.f = x.k OR x.f = x.k - 1) GROUP BY 1""")
def resolved_paths(spark, d):
    h = v.headers(spark, d).select(F.concat(F.lit("h"), F.col("header_key").cast("string")).alias("tile_id"), "file_path", (F.col("header_key") % 6).alias("k"))
    place = F.array(F.concat(F.lit("data/public/"), "file_path"), F.concat(F.lit("data/public/tiles/"), "tile_id", F.lit(".png")),
                    F.concat(F.lit("data/public/tiles/"), "tile_id", F.lit(".jpg")), F.col("file_path"))
    files = h.select("k", F.posexplode(place).alias("f", "path")).where((F.col("f") + 1 == F.col("k")) | (F.col("f") + 2 == F.col("k")))
    return S.resolve_paths(h.drop("k"), files).select("tile_id", "found_path")



# ---- written tables, read back by the real readers

@query("S3", """
SELECT 'sc_' || c_custkey AS scene_id, c_mktsegment AS sensor, CASE WHEN c_custkey % 10 = 0 THEN '/new/' ELSE '/old/' END || c_custkey AS file_path, c_nationkey::INT AS width FROM customer""")
def manifest_replaced(spark, d):
    """A scene manifest as CSV; every tenth record is replaced, and the manifest written and read again."""
    from orbitloom import schemas
    from orbitloom.session import new_table_path

    c = v.table(spark, d, "customer")
    given = {"scene_id": F.concat(F.lit("sc_"), F.col("c_custkey").cast("string")), "sensor": F.col("c_mktsegment"),
             "file_path": F.concat(F.lit("/old/"), F.col("c_custkey").cast("string")), "width": F.col("c_nationkey").cast("int")}
    empty = spark.createDataFrame([], schemas.SCENE_MANIFEST).schema
    rows = c.select("c_custkey", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])
    first, second = new_table_path(spark, "manifest"), new_table_path(spark, "manifest")
    S.write_scene_manifest(rows, first)
    record = rows.where("c_custkey % 10 = 0").drop("c_custkey").withColumn("file_path", F.regexp_replace("file_path", "^/old/", "/new/"))
    S.write_scene_manifest(S.replace_in_manifest(S.read_scene_manifest(spark, first), record), second)
    return S.read_scene_manifest(spark, second).select("scene_id", "sensor", "file_path", "width")


@query("S10", """
SELECT 'q-' || sha256(query_id) AS query_id, query_type, round(latency_ms, 6) AS latency_ms FROM v_query_log""")
def appended_log(spark, d):
    """Query-log rows appended in two writes and read back."""
    from orbitloom.session import new_table_path

    log = v.query_log(spark, d)
    none = F.lit(None).cast("string")
    rows = log.select("event_id", F.col("query_id").alias("query_key"), "query_type", none.alias("query_text"), none.alias("query_tile_id"),
                      F.lit(None).cast("array<double>").alias("bbox"), none.alias("date_from"), none.alias("date_to"), none.alias("sensor"),
                      F.lit(0).alias("result_count"), "latency_ms", "created_at")
    path = new_table_path(spark, "log")
    for half in (0, 1):
        S.append(A.query_log_rows(rows.where(F.col("event_id") % 2 == half)), path, ["query_type"])
    return spark.read.parquet(path).select("query_id", "query_type", F.round("latency_ms", 6).alias("latency_ms"))


@query("C13", """
SELECT 'rev-' || sha256(r.analysis_id || '|' || 'a' || r.analysis_id % 3 || '|' || decision) AS review_id, r.analysis_id::VARCHAR AS analysis_id, decision
FROM (SELECT analysis_id * 2 AS analysis_id, decision FROM v_reviews) r JOIN documents ON r.analysis_id = doc_id WHERE decision IN ('confirmed', 'rejected', 'uncertain')""")
def reviews_inserted(spark, d):
    """Accepted reviews appended to the review table and read back."""
    from orbitloom.session import new_table_path

    known = v.table(spark, d, "documents").select(F.col("doc_id").alias("analysis_id"))
    reviews = v.reviews(spark, d).withColumn("analysis_id", F.col("analysis_id") * 2).withColumns({
        "analyst": F.concat(F.lit("a"), (F.col("analysis_id") % 3).cast("string")), "tile_id": F.lit(None).cast("string"), "notes": F.lit(None).cast("string")})
    path = new_table_path(spark, "reviews")
    S.append(FL.accepted_reviews(reviews, known, "2024-06-01 00:00:00"), path)
    return spark.read.parquet(path).select("review_id", "analysis_id", "decision")


@query("J15", """
SELECT a.tile_id AS t1_tile_id, b.tile_id AS t2_tile_id, coalesce(CASE WHEN a.vec_id % 2 = 0 THEN DATE '2020-01-01' END, s.acquisition_date)::VARCHAR AS t1_date, u.acquisition_date::VARCHAR AS t2_date
FROM v_tiles a JOIN v_scenes s ON a.scene_id = s.scene_id LEFT JOIN v_tiles b0 ON b0.vec_id = a.vec_id + 1 LEFT JOIN v_scenes u ON b0.scene_id = u.scene_id,
LATERAL (SELECT """ + tile_name("(a.vec_id + 1)") + """ AS tile_id) b""")
def pair_dates(spark, d):
    """Every tile and the next one as a pair; given dates stay, missing ones come from the scenes."""
    from orbitloom.plans.change_analysis import with_dates

    t = v.tiles(spark, d)
    pairs = t.select(
        F.col("tile_id").alias("t1_tile_id"), v.tile_name(F.col("vec_id") + 1).alias("t2_tile_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("2020-01-01").cast("date")).alias("t1_date"), F.lit(None).cast("date").alias("t2_date"))
    out = with_dates(pairs, t, v.scenes(spark, d))
    return out.select("t1_tile_id", "t2_tile_id", F.col("t1_date").cast("string").alias("t1_date"), F.col("t2_date").cast("string").alias("t2_date"))

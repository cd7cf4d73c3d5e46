from pyspark.sql import functions as F

from orbitloom.functions import naming as N
from orbitloom.operators import catalog as C, filters as FL, tiling as T
from orbitloom.plans import ingest


def filter_rows(spark):
    return spark.createDataFrame(
        [("t1", "2026-01-15", "Sentinel-2", 91.65, 26.10, 91.70, 26.15), ("t2", "2026-03-20", "Sentinel-2", 91.70, 26.15, 91.75, 26.20),
         ("t3", "2026-05-10", "Landsat-8", 91.75, 26.20, 91.80, 26.25), ("t4", None, None, None, None, None, None)],
        "tile_id string, d string, sensor string, bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double",
    ).withColumn("acquisition_date", F.col("d").cast("date"))


def ids(df):
    return sorted(r.tile_id for r in df.collect())


def test_date_range_sensor_and_no_filter(spark):
    df = filter_rows(spark)
    assert ids(FL.metadata_filter(df, date_from="2026-02-01", date_to="2026-04-01")) == ["t2"]
    assert ids(FL.metadata_filter(df, date_from="2026-01-15", date_to="2026-03-20")) == ["t1", "t2"]
    assert ids(FL.metadata_filter(df, sensor="landsat-8")) == ["t3"]
    assert ids(FL.metadata_filter(df, bbox=[], date_from="", sensor="")) == ["t1", "t2", "t3", "t4"]


def test_bbox(spark):
    df = spark.createDataFrame(
        [("t1", 91.65, 26.10, 91.70, 26.15), ("t2", 92.00, 27.00, 92.10, 27.10), ("t3", 91.80, 26.20, 91.90, 26.30), ("t4", None, 1.0, 2.0, 3.0)],
        "tile_id string, bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double")
    assert ids(FL.metadata_filter(df, bbox=[91.60, 26.00, 91.75, 26.18])) == ["t1"]
    assert ids(FL.metadata_filter(df, bbox=[91.60, 26.00, 91.80, 26.20])) == ["t1", "t3"]  # touching counts


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderstatus", "sensor")
    plan = df.where(F.col("sensor") == "F").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_names(spark):
    cases = [
        ("/raw/S2A_MSIL2A_20260115_TEST.tif", "Sentinel-2", "2026-01-15", "SENT_20260115_S2A_MSIL2A_20260115_TEST"),
        ("S1_x.tif", "Sentinel-1", None, "SENT_S1_x"),
        ("sentinel-1 a 2024-03-05.tiff", "Sentinel-1", "2024-03-05", "SENT_20240305_sentinel-1_a_2024-03-05"),
        ("LC09_20240230_2024_02_03.tif", "Landsat-9", "2024-02-03", "LAND_20240203_LC09_20240230_2024_02_03"),
        ("planet.x.tif", "PlanetScope", None, "PLAN_planet_x"),
        ("MYD13_20240101.tif", "MODIS", "2024-01-01", "MODI_20240101_MYD13_20240101"),
        ("plain.tif", None, None, "plain"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "file_path string")
    got = {r.file_path: (r.sensor, r.acquisition_date, r.scene_id) for r in C.scene_metadata(df).collect()}
    for path, *want in cases:
        assert got[path] == tuple(want), path


def test_override_empty_is_no_override(spark):
    df = spark.createDataFrame([("S2_a.tif", "", "X"), ("S2_b.tif", None, "X"), ("S2_c.tif", "Mine", "")], "file_path string, s string, d string")
    got = sorted((r.sensor, r.acquisition_date) for r in C.scene_metadata(df, "s", "d").collect() if r.file_path != "S2_c.tif")
    assert got == [("Sentinel-2", "X"), ("Sentinel-2", "X")]
    assert N.suffix is not None


def scene(spark, w, h, minx=91.65, miny=26.10, maxx=91.85, maxy=26.25):
    return spark.createDataFrame([("S", w, h, minx, miny, maxx, maxy)], "scene_id string, width int, height int, bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double")


def test_grid_counts_and_bounds(spark):
    g = T.tile_grid(scene(spark, 512, 512)).collect()
    assert sorted(r.tile_id for r in g) == ["S_x00_y00", "S_x00_y01", "S_x01_y00", "S_x01_y01"]
    assert all(91.65 <= r.center_lon <= 91.85 and 26.10 <= r.center_lat <= 26.25 for r in g)
    assert T.tile_grid(scene(spark, 1024, 1024)).count() == 16  # columns cover 928 pixels, the rest is dropped
    assert T.tile_grid_plain(scene(spark, 1024, 800)).count() == 12
    small = T.tile_grid(scene(spark, 200, 300)).collect()
    assert [(r.win_width, r.win_height) for r in small] == [(200, 256)]
    assert T.tile_grid(scene(spark, 100, 300)).count() == 0  # under half a tile
    top = [r for r in g if r.y_index == 0][0]
    assert abs(top.bounds_maxy - 26.25) < 1e-12


def test_pixels_fall_into_overlapping_tiles(spark):
    px = spark.createDataFrame([("S", 0, 0, 1), ("S", 230, 230, 2), ("S", 230, 10, 3), ("S", 511, 511, 4)], "scene_id string, row int, col int, red int")
    got = T.pixels_to_tiles(px, scene(spark, 512, 512), 256, 32).groupBy("red").count().collect()
    assert {r.red: r["count"] for r in got} == {1: 1, 2: 4, 3: 2}  # the last pixel lies in the dropped remainder


def test_ingest_status_and_tables(spark):
    h = spark.createDataFrame(
        [("/r/S2A_20260115_A.tif", True, True, "EPSG:4326", 512, 512, 4), ("/r/x.png", True, True, None, 5, 5, 3), ("/r/gone.tif", False, True, None, 5, 5, 3),
         ("/r/S2A_20260116_B.tif", True, True, None, 512, 512, 2), ("/r/e.tif", True, True, None, 0, 0, 0)],
        "file_path string, present boolean, readable boolean, crs string, width int, height int, band_count int",
    ).selectExpr("*", "0.0D AS bounds_minx", "0.0D AS bounds_miny", "1.0D AS bounds_maxx", "1.0D AS bounds_maxy")
    v = {r.file_path: r for r in C.validate_scenes(h).collect()}
    assert v["/r/x.png"].errors == ["Unsupported format: .png"] and not v["/r/x.png"].valid
    assert v["/r/gone.tif"].errors == ["File not found"]
    assert v["/r/e.tif"].errors == ["No bands found in raster", "Zero-dimension raster"]
    assert v["/r/S2A_20260116_B.tif"].warnings == ["No CRS defined", "Only 2 band(s)"] and v["/r/S2A_20260116_B.tif"].valid
    known = spark.createDataFrame([("SENT_20260116_S2A_20260116_B",)], "scene_id string")
    res = {r.file_path: (r.status, r.tiles_created) for r in ingest.ingest_results(h, known).collect()}
    assert res["/r/S2A_20260115_A.tif"] == ("success", 4) and res["/r/S2A_20260116_B.tif"] == ("skipped", 0) and res["/r/e.tif"][0] == "error"
    assert C.ingest_summary(ingest.ingest_results(h, known)).first().asDict() == {"total": 5, "success": 1, "tiles_created": 4}
    scenes, tiles = ingest.catalog_tables(h, known, "2026-01-01 00:00:00")
    assert [r.scene_id for r in scenes.collect()] == ["SENT_20260115_S2A_20260115_A"] and tiles.count() == 4


def test_upsert_and_insert(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, at int")
    upd = spark.createDataFrame([("b", 5, 1), ("b", 9, 3), ("b", 7, 2), ("c", 3, 1)], "k string, v int, at int")
    assert sorted((r.k, r.v) for r in C.upsert(base, upd, ["k"], ["at"]).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted((r.k, r.v) for r in C.insert_absent(base, upd, ["k"], ["at"]).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted((r.k, r.v, r.status) for r in C.insert_status(upd, base, ["k"]).collect())[-1] == ("c", 3, "success")


def test_reviews_and_requests(spark):
    rev = spark.createDataFrame([("a", "confirmed"), ("a", "no"), ("z", "rejected"), ("a", None)], "analysis_id string, decision string")
    known = spark.createDataFrame([("a",)], "analysis_id string")
    assert sorted(r.status for r in FL.review_checks(rev, known).collect()) == ["accepted", "bad_decision", "bad_decision", "unknown_analysis"]
    req = spark.createDataFrame([(1, 0.0), (200, 1.0), (0, 0.5), (201, 0.5), (20, 1.1), (None, None)], "top_k int, score double")
    assert [r.status for r in FL.search_checks(req).collect()] == ["accepted", "accepted", "bad_top_k", "bad_top_k", "bad_score", "accepted"]


# ---- coordinates and repeated scenes

def forward_utm(lon, lat, zone, south):
    """Longitude and latitude to metres, by the forward series: an independent check of the inverse."""
    import math

    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + 0.9996 * radius * x, (1e7 if south else 0) + 0.9996 * radius * y


def test_utm_bounds_become_degrees(spark):
    from orbitloom.operators.catalog import geographic_bounds

    points = [(93.0, 26.0, 46, False), (91.65, 26.1, 46, False), (-70.5, -33.4, 19, True), (0.0, 0.0, 31, False), (179.9, 70.0, 60, False), (-177.0, -79.0, 1, True)]
    rows = []
    for k, (lon, lat, zone, south) in enumerate(points):
        east, north = forward_utm(lon, lat, zone, south)
        rows.append((k, f"EPSG:32{7 if south else 6}{zone:02d}", east, north, east, north))
    rows += [(90, "EPSG:4326", 1.0, 2.0, 3.0, 4.0), (91, None, 1.0, 2.0, 3.0, 4.0), (92, "EPSG:3857", 1.0, 2.0, 3.0, 4.0), (93, "EPSG:32661", 1.0, 2.0, 3.0, 4.0), (94, "epsg:32646", 500000.0, 0.0, 500000.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, crs string, bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double")
    got = {r.k: r for r in geographic_bounds(df).collect()}
    for k, (lon, lat, _, _) in enumerate(points):
        assert abs(got[k].bounds_minx - lon) < 1e-9 and abs(got[k].bounds_maxy - lat) < 1e-9 and got[k].crs_status == "utm"
    assert (got[90].bounds_minx, got[91].bounds_maxy, got[90].crs_status) == (1.0, 4.0, "degrees")
    assert {(got[k].bounds_minx, got[k].crs_status) for k in (92, 93)} == {(None, "unsupported")}
    assert abs(got[94].bounds_minx - 93.0) < 1e-9 and got[94].bounds_miny == 0.0


def test_a_scene_given_twice_is_ingested_once(spark):
    from orbitloom.plans.ingest import catalog_tables, ingest_results

    ddl = "file_path string, present boolean, readable boolean, crs string, width int, height int, band_count int, bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double"
    one = (True, True, "EPSG:32646", 512, 512, 4, 300000.0, 2890000.0, 305120.0, 2895120.0)
    rows = [("/b/S2A_20260115_T.tif", *one), ("/a/S2A_20260115_T.tif", *one), ("/a/S2A_20260115_T.tif", *one), ("/a/S2A_20260116_K.tif", *one), ("/a/bad.png", *one)]
    headers = spark.createDataFrame(rows, ddl)
    known = spark.createDataFrame([("SENT_20260116_S2A_20260116_K",)], "scene_id string")
    got = {r.file_path: (r.status, r.tiles_created) for r in ingest_results(headers, known).collect()}
    assert got == {"/a/S2A_20260115_T.tif": ("success", 4), "/b/S2A_20260115_T.tif": ("skipped", 0), "/a/S2A_20260116_K.tif": ("skipped", 0), "/a/bad.png": ("error", 0)}
    scenes, tiles = catalog_tables(headers, known, "2026-01-20 00:00:00")
    assert [r.file_path for r in scenes.collect()] == ["/a/S2A_20260115_T.tif"]
    rows = tiles.collect()
    assert len(rows) == len({r.tile_id for r in rows}) == 4
    assert all(90 < r.bounds_minx < r.center_lon < r.bounds_maxx < 92 and 26 < r.bounds_miny < r.center_lat < r.bounds_maxy < 27 for r in rows)

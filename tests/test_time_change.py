import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitloom.functions import spectral as S
from orbitloom.operators import change as C, morphology as M, raster as R, temporal as T
from orbitloom.plans import change_analysis as P


# ---- time

def test_colocation_equals_the_naive_join(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{i}", f"s{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.uniform(-0.3, 0.3, (150, 2)), 2))]
    tiles = spark.createDataFrame(rows, "tile_id string, scene_id string, center_lat double, center_lon double")
    got = {(r.loc_lat, r.loc_lon, r.near_lat, r.near_lon) for r in T.nearby_locations(tiles).collect()}
    locs = {(a, b) for _, _, a, b in rows}
    want = {(*p, *q) for p in locs for q in locs if abs(p[0] - q[0]) < 0.05 and abs(p[1] - q[1]) < 0.05}
    assert got == want
    plan = T.nearby_locations(tiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_timeline_and_pairs(spark, scenes_and_tiles):
    scenes, tiles = scenes_and_tiles
    ask = spark.createDataFrame([("t2_0",), ("t4_0",)], "tile_id string")
    rows = T.tile_timeline(ask, tiles, scenes).orderBy("reference", "position").collect()
    assert [r.tile_id for r in rows if r.reference == "t2_0"] == ["t1_0", "t1_1", "t2_0", "t2_1", "t3_0", "t3_1"]
    assert [r.tile_id for r in rows if r.reference == "t4_0"][-1] == "t4_0"  # undated goes last
    best = {r.reference: (r.t1_tile_id, r.t2_tile_id) for r in T.best_pairs(tiles, scenes).collect()}
    assert best["t2_0"] == ("t1_0", "t3_1") and best["t1_1"] == ("t1_1", "t3_1") and best["t3_1"] == ("t1_0", "t3_0") and best["t4_0"] == ("t1_0", "t3_1")
    assert best["t1_2"] == ("t1_2", "t3_2")
    req = spark.createDataFrame([("t2_0", "t2_0", "t3_0"), ("t1_0", "t1_0", ""), ("t3_0", "t3_2", "t1_0")], "reference string, t1_tile_id string, t2_tile_id string")
    got = {r.reference: (r.t1_tile_id, r.t2_tile_id) for r in T.chosen_pairs(req, tiles, scenes).collect()}
    assert got == {"t2_0": ("t2_0", "t3_0"), "t1_0": ("t1_0", "t3_1"), "t3_0": (None, "t1_0")}


def test_pair_sample_covers_all_when_limit_is_high(spark, scenes_and_tiles):
    scenes, tiles = scenes_and_tiles
    assert T.pair_sample(tiles, scenes, 100).count() == 9 == T.pair_counts(tiles, scenes).agg(F.sum("pairs")).first()[0]
    assert [(r.t1_tile_id, r.t2_tile_id) for r in T.pair_sample(tiles, scenes, 2).collect()] == [("t1_0", "t2_0"), ("t1_0", "t3_0")]


def test_footprints(spark, scenes_and_tiles):
    scenes, tiles = scenes_and_tiles
    ref = tiles.where("tile_id = 't4_0'")
    got = sorted((r.tile_id, r.iou) for r in T.footprint_overlaps(ref, tiles, scenes).collect())
    assert got == [("t1_0", 1.0), ("t2_0", 1.0), ("t3_0", 1.0)]


@pytest.mark.parametrize("rows,want", [
    ([(1, 9.0, True), (2, 9.0, True), (3, 0.0, True)], 1),
    ([(1, 9.0, True), (2, 2.0, True), (3, 9.0, True), (4, 0.0, True)], 3),   # exactly 2 % stops the walk
    ([(1, 9.0, True), (2, 0.0, False), (3, 9.0, True), (4, 0.0, True)], 1),  # no image: skipped
    ([(1, 9.0, True), (2, 1.0, True), (3, 0.0, True)], 3),
    ([(1, 9.0, True)], None),
    ([(1, 9.0, True), (2, 9.0, False)], None),
])
def test_earliest_supported(spark, rows, want):
    df = spark.createDataFrame([("a", i, i, c, h) for i, c, h in rows], "site string, obs_id int, n int, change_pct double, has_image boolean")
    df = df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    got = T.earliest_supported(df).first().earliest_supported
    assert (got.day - 1 if got else None) == want


def test_nested_timelines_keep_every_observation_of_a_hot_site(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('s', id % 500)) AS site", "date_add(DATE '2020-01-01', cast(id % 700 AS int)) AS date", "concat('t', id) AS tile_id", "'x' AS sensor")
    out = T.nested_timeline(df, ["site"], chunk=100)
    assert out.agg(F.sum(F.size("observations"))).first()[0] == 5000
    assert out.agg(F.max(F.size("observations"))).first()[0] == 100
    hot = [e for r in out.where("site = 'hot'").orderBy("chunk").collect() for e in r.observations]
    assert [e.position for e in hot] == list(range(1, 1668)) and [e.date for e in hot] == sorted(e.date for e in hot)


# ---- pixels

def frame(spark, img, pair="p", suffix=""):
    h, w, n = img.shape
    rows = [(pair, r, c, *[int(x) for x in img[r, c]], *([None] * (4 - n))) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "pair_id string, row int, col int, red int, green int, blue int, nir int")


def test_quality_of_plain_images(spark):
    mid = R.quality(frame(spark, np.full((16, 16, 3), 100)), ["pair_id"]).first()
    bright = R.quality(frame(spark, np.full((16, 16, 3), 245)), ["pair_id"]).first()
    assert mid.cloud_fraction == 0 and mid.overall_quality == 0.8
    assert bright.cloud_fraction == 1.0 and bright.overall_quality < mid.overall_quality
    tiles = spark.createDataFrame([("p",), ("none",)], "pair_id string")
    worst = R.quality_or_worst(tiles, R.quality(frame(spark, np.full((4, 4, 3), 100)), ["pair_id"]), ["pair_id"]).where("pair_id = 'none'").first()
    assert (worst.cloud_fraction, worst.overall_quality) == (1.0, 0.0)


def matched(src, ref):
    sv, si, sc = np.unique(src.ravel(), return_inverse=True, return_counts=True)
    rv, rc = np.unique(ref.ravel(), return_counts=True)
    return np.interp(np.cumsum(sc) / sc.sum(), np.cumsum(rc) / rc.sum(), rv)[si].reshape(src.shape)


def test_matching_and_threshold_against_numpy(spark):
    rng = np.random.default_rng(42)
    a, b = rng.integers(50, 200, (24, 20, 3)), rng.integers(80, 220, (22, 24, 3))
    got = P.matched_difference(frame(spark, a), frame(spark, b)).collect()
    a, b = a[:22, :20], b[:22, :20]  # cropped to the common area
    diff = np.mean([np.abs(matched(b[..., k], a[..., k]) - a[..., k]) for k in range(3)], axis=0)
    assert len(got) == 22 * 20
    assert all(abs(r["diff"] - diff[r.row, r.col]) < 1e-9 for r in got)
    assert abs(got[0].threshold - max(diff.mean() + 2 * diff.std(), 30)) < 1e-9


def numpy_morph(mask):
    h, w = mask.shape

    def hood(m, fill):
        p = np.pad(m, 2, constant_values=fill)
        return np.stack([p[2 + dr:2 + dr + h, 2 + dc:2 + dc + w] for dr, dc in M.DISK])

    er, di = (lambda m: hood(m, True).all(axis=0)), (lambda m: hood(m, False).any(axis=0))
    return er(di(di(er(mask))))


def test_morphology_and_regions_against_numpy(spark):
    rng = np.random.default_rng(7)
    m = rng.random((30, 34)) < 0.25
    m[5:15, 4:16] = True
    m[20:30, 20:34] = True
    m[0:3, 0:5] = True
    rows = [("p", int(r), int(c), 30, 34) for r, c in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "pair_id string, row int, col int, height int, width int")
    cleaned = {(r.row, r.col) for r in M.clean(df).collect()}
    want = numpy_morph(m)
    assert cleaned == set(zip(*map(lambda x: x.tolist(), np.nonzero(want))))
    # regions by flood fill on the raw mask
    todo, areas = set(zip(*map(lambda x: x.tolist(), np.nonzero(m)))), {}
    while todo:
        seed = min(todo)
        stack, seen = [seed], {seed}
        while stack:
            r, c = stack.pop()
            for n in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in todo and n not in seen:
                    seen.add(n)
                    stack.append(n)
        todo -= seen
        for p in seen:
            areas[p] = (seed[0] * (1 << 20) + seed[1], len(seen))
    got = {(r.row, r.col): (r.region, r.area) for r in M.regions(df).collect()}
    assert got == areas
    assert all(a >= 50 for _, a in ((r.row, r.area) for r in M.large_regions(M.regions(df)).collect()))


@pytest.mark.parametrize("dy,dx,quality,risk", [(0, 0, 1.0, 0.0), (1, 0, 0.8, 0.3333), (0, -3, 0.4, 1.0), (4, 3, 0.0, 1.0)])
def test_shift_of_a_rolled_image(spark, dy, dx, quality, risk):
    a = np.random.default_rng(1).integers(0, 255, (24, 30, 3))
    b = np.roll(a, (dy, dx), axis=(0, 1))
    r = M.shift_estimates(R.pair_pixels(frame(spark, a), frame(spark, b))).first()
    assert (r.shift_y, r.shift_x, r.registration_quality, r.edge_artifact_risk) == (-dy, -dx, quality, risk)


def test_texture_with_mirrored_borders(spark):
    img = np.random.default_rng(2).integers(0, 255, (20, 11, 3))
    b = img.sum(axis=2) / 765.0
    p = np.pad(b, 8, mode="symmetric")
    win = np.lib.stride_tricks.sliding_window_view(p, (16, 16))[:20, :11]
    want = np.sqrt(np.maximum((win ** 2).mean(axis=(2, 3)) - win.mean(axis=(2, 3)) ** 2, 0))
    got = R.texture(frame(spark, img).withColumnRenamed("pair_id", "tile_id")).collect()
    assert len(got) == 220 and all(abs(r.texture - want[r.row, r.col]) < 1e-7 for r in got)


def test_end_to_end_block(spark):
    rng = np.random.default_rng(0)
    a = np.full((40, 40, 4), 100) + rng.integers(0, 20, (40, 40, 4))
    a[:5] = 225 + rng.integers(0, 10, (5, 40, 4))
    a[12:22, 12:22] = 20
    b = a.copy()
    b[12:22, 12:22] = 250
    pairs = spark.createDataFrame([("p", "t", "t1", "t2", "2024-01-01", "2024-01-11"), ("gone", "t9", "a", "b", None, None)],
                                  "pair_id string, tile_id string, t1_tile_id string, t2_tile_id string, t1_date string, t2_date string")
    out = {r.pair_id: r for r in P.analyze_pairs(pairs, frame(spark, a), frame(spark, b)).collect()}
    r = out["p"]
    assert r.status == "completed" and r.region_count == 1 and 80 <= r.change_pixels <= 100 and r.total_pixels == 1600
    assert r.structural == 1.0 and r.change_type == "moderate_change" and r.doy_diff_days == 10 and r.seasonal_confound == 0.05
    bad = out["gone"]
    assert (bad.status, bad.label, bad.final_score, bad.change_type, bad.total_pixels) == ("error", "ERROR", 0.0, None, 0)
    rec = P.analysis_records(P.analyze_pairs(pairs, frame(spark, a), frame(spark, b)), "2024-02-01 00:00:00").collect()
    assert len(rec) == 1 and rec[0].analysis_id.startswith("chg-") and rec[0].confidence == r.final_score


# ---- decision rules at their thresholds

def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("dv,dw,db,want", [
    (-0.11, 0.19, 0.0, "water_inundation_or_flood"), (-0.10, 0.19, 0.0, "unclassified_structural"), (-0.23, 0.18, 0.0, "vegetation_loss_or_clearing"),
    (-0.22, 0.0, 0.15, "unclassified_structural"), (0.23, 0.9, 0.0, "vegetation_greening"), (-0.06, 0.0, 0.16, "urban_construction_or_expansion"),
    (0.07, -0.07, 0.07, "illumination_or_texture_shift"), (0.08, 0.0, 0.0, "unclassified_structural"),
])
def test_driver(spark, dv, dw, db, want):
    assert one(spark, C.driver(F.lit(9), F.lit(dv), F.lit(dw), F.lit(db))) == want


def test_no_pixels_and_spectral_score(spark):
    assert one(spark, C.driver(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == "none"
    assert [one(spark, C.spectral_score(F.lit(p), F.lit(c))) for p, c in ((0, True), (5, True), (5, False))] == [0.7, 1.0, 0.35]


@pytest.mark.parametrize("d1,d2,penalty,days", [
    ("2024-01-01", "2024-01-30", 0.05, 29), ("2024-01-01", "2024-01-31", 0.20, 30), ("2024-01-01", "2024-03-16", 0.45, 75), ("2023-01-01", "2023-05-21", 0.70, 140),
    ("2023-01-01", "2023-12-31", 0.05, 1), (None, "2024-01-01", 0.15, 0), ("2024-99-01", "2024-01-01", 0.15, 0), ("2024-01-01T10:00:00", "2024-01-01", 0.05, 0),
])
def test_season(spark, d1, d2, penalty, days):
    a, b = F.lit(d1).cast("string"), F.lit(d2).cast("string")
    assert (one(spark, S.season_penalty(a, b)), one(spark, S.doy_distance(a, b))) == (penalty, days)


def test_score_bounds_labels_and_types(spark):
    assert [one(spark, C.score_label(F.lit(x))) for x in (0.72, 0.7199, 0.45, 0.4499)] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert one(spark, C.final_score(*[F.lit(float(x)) for x in (0, 0, 0, 0, 1, 1)])) == 0.05
    assert abs(one(spark, C.final_score(*[F.lit(float(x)) for x in (1, 1, 1, 0.8, 0.05, 0)])) - 0.865) < 1e-12
    kinds = [one(spark, C.change_type(F.lit(p), F.lit(s))) for p, s in ((0.99, 0.9), (1.0, 0.3), (1.0, 0.29), (5.0, 0.9), (5.01, 0.9), (15.0, 0.9), (15.01, 0.9))]
    assert kinds == [None, "minor_change", None, "minor_change", "moderate_change", "moderate_change", "major_change"]
    assert [one(spark, C.seasonal_confound(F.lit(r), F.lit(0.2))) for r in (0.30, 0.31, 0.55, 0.56)] == [0.2, 0.45, 0.45, 0.75]
    assert one(spark, C.structural_score(F.lit(120.0))) == 1.0 and one(spark, C.structural_score(F.lit(None).cast("double"))) == 0.0
    assert [one(spark, C.trust_gate(F.lit(x))) for x in ("HIGH", "MEDIUM", "LOW")] == ["READY", "NEEDS REVIEW", "SUPPRESSED"]
    assert one(spark, C.changed_hectares(F.lit(50))) == 0.5


def test_band_views(spark):
    px = frame(spark, np.full((2, 2, 4), 7)).withColumnRenamed("pair_id", "tile_id")
    assert R.band_view(px, "cir").columns == R.band_view(px, "rgb").columns
    assert R.band_view(px, "ndvi").first().level == 127


def test_boxes_of_any_size(spark):
    """Boxes from a few meters to the whole world against every pair looked at; a box takes a bounded number of rows."""
    import random

    rng = random.Random(11)
    def box():
        w, h = 10 ** rng.uniform(-4, 2.5), 10 ** rng.uniform(-4, 2.2)
        x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
        return (x, y, x + w, y + h)
    boxes = [box() for _ in range(150)] + [(-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 0.0, 0.0), (0.05, 0.05, 0.1, 0.1), (0.1, 0.1, 0.15, 0.15), (10.0, 10.0, 10.05, 10.05)]
    names = "bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double"
    df = spark.createDataFrame(boxes, names)
    got = sorted(tuple(r) for r in T.overlapping_boxes(df.limit(80).unionByName(df.orderBy("bounds_minx").limit(80)).distinct(), df).collect())
    left = {tuple(r) for r in df.limit(80).unionByName(df.orderBy("bounds_minx").limit(80)).collect()}
    want = sorted((*a, *b) for a in left for b in boxes if b[2] >= a[0] and b[0] <= a[2] and b[3] >= a[1] and b[1] <= a[3])
    assert got == want and len(want) > 500
    world = spark.createDataFrame([boxes[150]], names)
    assert T.overlapping_boxes(world, df).count() == sum(b[0] <= 180 and b[2] >= -180 and b[1] <= 90 and b[3] >= -90 for b in boxes)


def test_tiles_without_a_center_go_by_their_boxes(spark, scenes_and_tiles):
    scenes, tiles = scenes_and_tiles
    lost = tiles.withColumns({c: F.when(F.col("tile_id") != "t1_0", F.col(c)) for c in ("center_lon", "center_lat")})
    rows = T.tile_timeline(tiles.where("tile_id = 't1_0'").select("tile_id"), lost, scenes).orderBy("position").collect()
    assert [r.tile_id for r in rows] == ["t1_0", "t2_0", "t3_0"]  # only equal boxes overlap; the undated scene is left out
    best = {r.reference: (r.observations, r.t1_tile_id, r.t2_tile_id) for r in T.best_pairs(lost, scenes).collect()}
    assert best["t1_0"] == (3, "t1_0", "t3_0")
    nowhere = lost.withColumn("bounds_minx", F.when(F.col("tile_id") != "t1_0", F.col("bounds_minx")))
    assert "t1_0" not in {r.reference for r in T.best_pairs(nowhere, scenes).collect()}
    assert T.tile_timeline(tiles.where("tile_id = 't1_0'").select("tile_id"), nowhere, scenes).count() == 1

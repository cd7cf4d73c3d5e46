"""Pixel operators, change detection and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitloom.functions import spectral as SP
from orbitloom.operators import change as C, morphology as M, raster as R
from orbitloom.plans import change_analysis as P

from . import views as v
from .registry import query


def _r(c, n=4):
    return F.round(c, n).alias(c)


def _t1(spark, d):
    return v.pixels(spark, d).withColumn("pair_id", F.col("tile_id"))


def _t2(spark, d):
    return v.pixels_t2(spark, d).withColumn("pair_id", F.col("tile_id"))


_BANDS = ("red", "green", "blue", "nir")
_PAIRS = "SELECT a.tile_id AS pair_id, a.tile, a.row, a.col, " + ", ".join(f"a.{b} AS {b}1, b.{b} AS {b}2" for b in _BANDS) + \
    " FROM v_pixels a JOIN v_pixels_t2 b ON a.tile_id = b.tile_id AND a.row = b.row AND a.col = b.col"
_LONG = " UNION ALL ".join(f"SELECT pair_id, '{b}' AS band, {s} AS side, {b}{s} AS v FROM px" for b in _BANDS for s in (1, 2))
# matched values by the textbook definition: cumulative shares, then linear interpolation with clamped ends
_MAPPED = f"""
px AS ({_PAIRS}), long AS ({_LONG}),
cnt AS (SELECT pair_id, band, side, v, count(*) AS n FROM long GROUP BY ALL),
cdf AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, band, side ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY pair_id, band, side)::DOUBLE AS c FROM cnt),
src AS (SELECT * FROM cdf WHERE side = 2), ref AS (SELECT * FROM cdf WHERE side = 1),
lo AS (SELECT s.pair_id, s.band, s.v, max_by(r.v, r.c) AS lv, max(r.c) AS lc FROM src s JOIN ref r ON s.pair_id = r.pair_id AND s.band = r.band AND r.c <= s.c GROUP BY ALL),
hi AS (SELECT s.pair_id, s.band, s.v, min_by(r.v, r.c) AS hv, min(r.c) AS hc FROM src s JOIN ref r ON s.pair_id = r.pair_id AND s.band = r.band AND r.c >= s.c GROUP BY ALL),
map AS (SELECT s.pair_id, s.band, s.v, CASE WHEN lv IS NULL THEN hv::DOUBLE WHEN hv IS NULL THEN lv::DOUBLE WHEN hc = lc THEN lv::DOUBLE ELSE lv + (hv - lv) / (hc - lc) * (s.c - lc) END AS m
  FROM src s LEFT JOIN lo USING (pair_id, band, v) LEFT JOIN hi USING (pair_id, band, v))"""
_DIFF = _MAPPED + """,
diffs AS (SELECT px.*, (abs(m1.m - red1) + abs(m2.m - green1) + abs(m3.m - blue1) + abs(m4.m - nir1)) / 4 AS diff FROM px
  JOIN map m1 ON m1.pair_id = px.pair_id AND m1.band = 'red' AND m1.v = red2 JOIN map m2 ON m2.pair_id = px.pair_id AND m2.band = 'green' AND m2.v = green2
  JOIN map m3 ON m3.pair_id = px.pair_id AND m3.band = 'blue' AND m3.v = blue2 JOIN map m4 ON m4.pair_id = px.pair_id AND m4.band = 'nir' AND m4.v = nir2),
thr AS (SELECT pair_id, greatest(avg(diff) + 2 * stddev_pop(diff), 30.0) AS t, max(row) + 1 AS h, max(col) + 1 AS w, max(diff) AS top FROM diffs GROUP BY 1),
raw AS (SELECT d.pair_id, d.row, d.col, h, w FROM diffs d JOIN thr USING (pair_id) WHERE diff > t)"""
_DISK = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in M.DISK) + ") k(dr, dc)"
_COUNT_IN = " + ".join(f"(a.row + {dr} >= 0 AND a.row + {dr} < a.h AND a.col + {dc} >= 0 AND a.col + {dc} < a.w)::INT" for dr, dc in M.DISK)


def _erode(src: str, out: str) -> str:
    return f"""{out} AS (SELECT a.pair_id, a.row, a.col, a.h, a.w FROM {src} a JOIN {_DISK} ON true JOIN {src} b ON b.pair_id = a.pair_id AND b.row = a.row + dr AND b.col = a.col + dc
  GROUP BY ALL HAVING count(*) = {_COUNT_IN})"""


def _dilate(src: str, out: str) -> str:
    return f"""{out} AS (SELECT DISTINCT pair_id, (row + dr)::INT AS row, (col + dc)::INT AS col, h, w FROM {src}, {_DISK} WHERE row + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND w - 1)"""


_CLEAN = _DIFF + ", " + ", ".join([_erode("raw", "e1"), _dilate("e1", "d1"), _dilate("d1", "d2"), _erode("d2", "cleaned")])
_REGIONS = _CLEAN + """,
reach AS (SELECT pair_id, row AS r0, col AS c0, row, col FROM cleaned
  UNION SELECT x.pair_id, x.r0, x.c0, n.row, n.col FROM reach x JOIN cleaned n ON n.pair_id = x.pair_id AND abs(n.row - x.row) <= 1 AND abs(n.col - x.col) <= 1),
named AS (SELECT pair_id, r0 AS row, c0 AS col, min(row * 10000 + col) AS region, count(*) AS area FROM reach GROUP BY ALL)"""


# ---- single-date operators

@query("R1", """
SELECT tile_id, row, col, red, CASE WHEN tile % 4 = 0 THEN red ELSE green END AS green, CASE WHEN tile % 4 = 0 THEN red WHEN tile % 4 = 1 THEN 0 ELSE blue END AS blue,
  CASE WHEN tile % 4 = 3 THEN nir END AS nir FROM v_pixels""")
def harmonised_bands(spark, d):
    return R.harmonise(v.pixels(spark, d).withColumn("band_count", F.col("tile") % 4 + 1)).select("tile_id", "row", "col", *_BANDS)


@query("R2", """
WITH wide AS (SELECT tile_id, row, col, red * 40 AS red, green * 41 AS green, blue * 43 AS blue FROM v_pixels),
q AS (SELECT tile_id, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM (SELECT tile_id, unnest([red, green, blue]) AS x FROM wide) WHERE x > 0 GROUP BY 1)
SELECT tile_id, row, col, floor(least(greatest((red - lo) / (hi - lo) * 255, 0), 255))::INT AS red, floor(least(greatest((green - lo) / (hi - lo) * 255, 0), 255))::INT AS green,
  floor(least(greatest((blue - lo) / (hi - lo) * 255, 0), 255))::INT AS blue FROM wide JOIN q USING (tile_id)""")
def stretched_pixels(spark, d):
    wide = v.pixels(spark, d).select("tile_id", "row", "col", (F.col("red") * 40).alias("red"), (F.col("green") * 41).alias("green"), (F.col("blue") * 43).alias("blue"))
    return R.stretch(wide)


@query("R3", """
SELECT tile_id, round(c, 4) AS cloud_fraction, round(k, 4) AS dark_fraction, round(dr, 2) AS dynamic_range, round(s, 4) AS saturation_fraction,
  round(least(greatest(1.0::DOUBLE - c * 0.5 - k * 0.3 - s * 0.2 - CASE WHEN dr < 50 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 0.0), 1.0), 4) AS overall_quality
FROM (SELECT tile_id, avg(CASE WHEN g > 230 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c, avg(CASE WHEN g < 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS k, quantile_cont(g, 0.98) - quantile_cont(g, 0.02) AS dr,
  avg(CASE WHEN greatest(red, green, blue, nir) >= 250 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM (SELECT *, (red + green + blue + nir) / 4.0::DOUBLE AS g FROM v_pixels) GROUP BY 1)""")
def tile_quality(spark, d):
    return R.quality(v.pixels(spark, d), ["tile_id"])


@query("R4 R5", """
WITH p AS (SELECT tile_id, row, col, red::DOUBLE AS r, green::DOUBLE AS g, blue::DOUBLE AS b, CASE WHEN tile % 2 = 0 THEN nir::DOUBLE END AS n FROM v_pixels)
SELECT tile_id, row, col, round(CASE WHEN n IS NULL THEN (2 * g - r - b) / (2 * g + r + b + 1e-6) ELSE (n - r) / (n + r + 1e-6) END, 6) + 0.0 AS ndvi,
  round(CASE WHEN n IS NULL THEN (b - r) / (b + r + 1e-6) ELSE (g - n) / (g + n + 1e-6) END, 6) + 0.0 AS ndwi,
  round(CASE WHEN n IS NULL THEN (r - g) / (r + g + 1e-6) ELSE (r - n) / (r + n + 1e-6) END, 6) + 0.0 AS ndbi FROM p""")
def pixel_indices(spark, d):
    px = v.pixels(spark, d).withColumn("nir", F.when(F.col("tile") % 2 == 0, F.col("nir")))
    return R.indices(px).select("tile_id", "row", "col", *[_r(c, 6) for c in ("ndvi", "ndwi", "ndbi")])


@query("A13", """
SELECT tile_id, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, round(quantile_cont(x, 0.02), 4) AS p2,
  round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.98), 4) AS p98, round(avg(CASE WHEN x / 255.0::DOUBLE > 0.02 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS valid_ratio
FROM (SELECT tile_id, (red + green + blue) / 3.0::DOUBLE AS x FROM v_pixels) GROUP BY 1""")
def pixel_stats(spark, d):
    return R.pixel_stats(v.pixels(spark, d)).select("tile_id", *[_r(c) for c in ("mean", "std", "min", "max", "p2", "p95", "p98", "valid_ratio")])


_TEXTURE = """
dims AS (SELECT tile_id, max(row) + 1 AS h, max(col) + 1 AS w FROM v_pixels GROUP BY 1),
b AS (SELECT p.tile_id, row, col, h, w, (red + green + blue) / (3.0::DOUBLE * 255.0::DOUBLE) AS b FROM v_pixels p JOIN dims USING (tile_id)),
win AS (SELECT tile_id, row, col, o, CASE WHEN pmod_c < w THEN pmod_c ELSE 2 * w - 1 - pmod_c END AS sc FROM (SELECT DISTINCT tile_id, row, col, w FROM b), LATERAL (SELECT unnest(range(-8, 8)) AS o), LATERAL (SELECT ((col + o) % (2 * w) + 2 * w) % (2 * w) AS pmod_c)),
hsum AS (SELECT win.tile_id, win.row, win.col, sum(b.b) AS s, sum(b.b * b.b) AS ss, count(b.b) AS n FROM win JOIN b ON b.tile_id = win.tile_id AND b.row = win.row AND b.col = win.sc GROUP BY ALL),
vwin AS (SELECT tile_id, row, col, CASE WHEN pmod_r < h THEN pmod_r ELSE 2 * h - 1 - pmod_r END AS sr FROM (SELECT tile_id, row, col, h FROM b), LATERAL (SELECT unnest(range(-8, 8)) AS o), LATERAL (SELECT ((row + o) % (2 * h) + 2 * h) % (2 * h) AS pmod_r)),
tex AS (SELECT v.tile_id, v.row, v.col, sqrt(greatest(sum(ss) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 0.0)) AS texture FROM vwin v JOIN hsum k ON k.tile_id = v.tile_id AND k.row = v.sr AND k.col = v.col GROUP BY ALL)"""


@query("R14", f"WITH {_TEXTURE} SELECT tile_id, row, col, round(texture, 5) AS texture FROM tex")
def local_texture(spark, d):
    return R.texture(v.pixels(spark, d)).select("tile_id", "row", "col", F.round("texture", 5).alias("texture"))


_SUMMARY = f"""
WITH {_TEXTURE}, u AS (SELECT p.tile_id, red / 255.0::DOUBLE AS r, green / 255.0::DOUBLE AS g, blue / 255.0::DOUBLE AS b, CASE WHEN tile % 2 = 0 THEN nir / 255.0::DOUBLE
    ELSE least(greatest(green / 255.0::DOUBLE * 0.5 + red / 255.0::DOUBLE * 0.3 - blue / 255.0::DOUBLE * 0.2 + 0.2, 0.0), 1.0) END AS n, t.texture FROM v_pixels p JOIN tex t USING (tile_id, row, col)),
i AS (SELECT *, (n - r) / (n + r + 1e-8) AS ndvi, (g - n) / (g + n + 1e-8) AS ndwi, ((r + b) - (g + n)) / (abs((b + n) - (r + g) + 1e-8) + 1e-8) AS bsi, (r + g + b) / 3.0 AS br, count(*) OVER (PARTITION BY tile_id) AS total FROM u),
summary AS (SELECT tile_id, avg(ndvi) AS ndvi_mean, stddev_pop(ndvi) AS ndvi_std, quantile_cont(ndvi, 0.95) AS ndvi_max, avg(ndwi) AS ndwi_mean, avg(bsi) AS bsi_mean, avg(br) AS brightness_mean, stddev_pop(br) AS brightness_std,
  avg(texture) AS texture_mean, avg(r) AS red_mean, avg(g) AS green_mean, avg(b) AS blue_mean, count(*) / max(total)::DOUBLE AS valid_pixel_ratio FROM i WHERE br > 0.02 GROUP BY 1)"""
STATS = ("ndvi_mean", "ndvi_std", "ndvi_max", "ndwi_mean", "bsi_mean", "brightness_mean", "brightness_std", "texture_mean", "red_mean", "green_mean", "blue_mean", "valid_pixel_ratio")


def summary(spark, d):
    px = v.pixels(spark, d).withColumn("nir", F.when(F.col("tile") % 2 == 0, F.col("nir")))
    return R.index_summary(px)


@query("R15 F9", _SUMMARY + " SELECT tile_id, " + ", ".join(f"round({c}, {2 if c == 'bsi_mean' else 5}) + 0.0 AS {c}" for c in STATS) + " FROM summary")
def index_summary(spark, d):
    return summary(spark, d).select("tile_id", *[_r(c, 2 if c == "bsi_mean" else 5) for c in STATS])


@query("R18", """
SELECT tile_id, row, col, floor(CASE WHEN c = 0 THEN least(greatest(green * 1.6::DOUBLE + 20, 0), 255) WHEN c = 1 THEN least(greatest(blue * 0.15::DOUBLE, 0), 45)
  WHEN c = 2 THEN least(greatest((red + green + blue) / 3.0::DOUBLE * 0.9::DOUBLE, 0), 255) ELSE least(greatest(green * 1.1::DOUBLE + red * 0.4::DOUBLE, 0), 255) END)::INT AS nir FROM (SELECT *, tile % 4 AS c FROM v_pixels)""")
def synthetic_nir(spark, d):
    cls = v.pick(F.col("tile") % 4, ("Forest", "River", "Highway", "Residential"))
    return v.pixels(spark, d).select("tile_id", "row", "col", SP.synthetic_nir(cls, F.col("red"), F.col("green"), F.col("blue")).alias("nir"))


def _draw_sql(name: str) -> str:
    return f"('0x' || substr(md5(tile_id || '|{name}|7'), 1, 6))::BIGINT::DOUBLE / 16777216.0"


def _aug_band(b: str) -> str:
    return f"""CASE WHEN {_draw_sql('jitter')} > 0.3 THEN floor(least(greatest(least(greatest({b} * (1 + ({_draw_sql('gain_' + b)} * 2 - 1) * 0.1::DOUBLE), 0), 255) + ({_draw_sql('offset')} * 2 - 1) * 10.0, 0), 255)) ELSE {b} END::INT AS {b}"""


@query("R17", f"""
WITH t AS (SELECT *, max(row) OVER (PARTITION BY tile_id) + 1 AS h, max(col) OVER (PARTITION BY tile_id) + 1 AS w, floor({_draw_sql('turn')} * 4)::INT AS k FROM v_pixels),
m AS (SELECT *, CASE k WHEN 0 THEN row WHEN 1 THEN w - 1 - col WHEN 2 THEN h - 1 - row ELSE col END AS r2, CASE k WHEN 0 THEN col WHEN 1 THEN row WHEN 2 THEN w - 1 - col ELSE h - 1 - row END AS c2,
  CASE WHEN k % 2 = 0 THEN h ELSE w END AS h2, CASE WHEN k % 2 = 0 THEN w ELSE h END AS w2 FROM t)
SELECT tile_id, CASE WHEN {_draw_sql('flip_v')} > 0.5 THEN h2 - 1 - r2 ELSE r2 END::INT AS row, CASE WHEN {_draw_sql('flip_h')} > 0.5 THEN w2 - 1 - c2 ELSE c2 END::INT AS col, {_aug_band('red')}, {_aug_band('green')}, {_aug_band('blue')} FROM m""")
def augmented_tiles(spark, d):
    return R.augment(v.pixels(spark, d), seed=7)


@query("R4 R16", "SELECT tile_id, row, col, nir AS red, red AS green, green AS blue FROM v_pixels")
def infrared_view(spark, d):
    return R.band_view(v.pixels(spark, d), "cir")


# ---- two-date operators

@query("J14 W8 R6", f"WITH {_MAPPED} SELECT pair_id, band, v, round(m, 6) AS mapped FROM map")
def histogram_maps(spark, d):
    return R.histogram_maps(R.pair_pixels(_t1(spark, d), _t2(spark, d))).select("pair_id", "band", "v", F.round("mapped", 6).alias("mapped"))


@query("R6 R7 R8", f"WITH {_DIFF} SELECT d.pair_id, d.row, d.col, round(diff, 6) AS diff, round(t, 4) AS threshold, (diff > t)::INT AS raw_mask FROM diffs d JOIN thr USING (pair_id)")
def difference_masks(spark, d):
    return P.matched_difference(_t1(spark, d), _t2(spark, d)).select("pair_id", "row", "col", _r("diff", 6), _r("threshold"), "raw_mask")


@query("R9", f"WITH {_CLEAN} SELECT pair_id, row, col FROM cleaned")
def cleaned_masks(spark, d):
    return M.clean(P.raw_mask(P.matched_difference(_t1(spark, d), _t2(spark, d)))).select("pair_id", "row", "col")


@query("R10", f"WITH RECURSIVE {_REGIONS} SELECT pair_id, row, col, area, dense_rank() OVER (PARTITION BY pair_id ORDER BY region) AS region FROM named WHERE area >= 50")
def change_regions(spark, d):
    from pyspark.sql import Window

    lab = P.final_mask(P.matched_difference(_t1(spark, d), _t2(spark, d)))
    return lab.withColumn("region", F.dense_rank().over(Window.partitionBy("pair_id").orderBy("region"))).select("pair_id", "row", "col", "area", "region")


_IDX = """CASE WHEN true THEN ({n} - {r}) / ({n} + {r} + 1e-6) END"""


def _delta(a: str, b: str) -> str:
    return f"(({a}2 - {b}2) / ({a}2 + {b}2 + 1e-6::DOUBLE) - ({a}1 - {b}1) / ({a}1 + {b}1 + 1e-6::DOUBLE))"


_FACTS = _REGIONS + f""",
kept AS (SELECT * FROM named WHERE area >= 50),
facts AS (SELECT d.pair_id, count(*) AS total_pixels, count(k.region) AS change_pixels, count(DISTINCT k.region) AS region_count, avg(CASE WHEN k.region IS NOT NULL THEN diff END) AS mean_diff,
  avg(CASE WHEN k.region IS NOT NULL THEN {_delta('nir', 'red')} END) AS dv, avg(CASE WHEN k.region IS NOT NULL THEN {_delta('green', 'nir')} END) AS dw,
  avg(CASE WHEN k.region IS NOT NULL THEN {_delta('red', 'nir')} END) AS db FROM diffs d LEFT JOIN kept k USING (pair_id, row, col) GROUP BY 1)"""


@query("R11 R12", f"""WITH RECURSIVE {_FACTS} SELECT pair_id, total_pixels, change_pixels, region_count, round(100.0::DOUBLE * change_pixels / total_pixels, 2) AS change_percentage,
  round(mean_diff, 4) AS mean_masked_diff, round(dv, 4) + 0.0 AS delta_ndvi, round(dw, 4) + 0.0 AS delta_ndwi, round(db, 4) + 0.0 AS delta_ndbi FROM facts""")
def change_facts(spark, d):
    px = P.matched_difference(_t1(spark, d), _t2(spark, d))
    pct = F.round(F.col("change_pixels") / F.col("total_pixels") * 100, 2).alias("change_percentage")
    return P.pair_facts(px, P.final_mask(px)).select(
        "pair_id", "total_pixels", "change_pixels", "region_count", pct, _r("mean_masked_diff"), _r("delta_ndvi"), _r("delta_ndwi"), _r("delta_ndbi")
    )


@query("R16", f"""WITH RECURSIVE {_REGIONS} SELECT d.pair_id, d.row, d.col, CASE WHEN k.region IS NOT NULL AND top > 0 THEN floor(diff / top * 255) ELSE 0 END::INT AS out_red,
  CASE WHEN k.region IS NOT NULL THEN 0 ELSE 50 END::INT AS out_green, 0 AS out_blue FROM diffs d JOIN thr USING (pair_id) LEFT JOIN (SELECT * FROM named WHERE area >= 50) k USING (pair_id, row, col)""")
def mask_layers(spark, d):
    px = P.matched_difference(_t1(spark, d), _t2(spark, d))
    keep = P.final_mask(px).select("pair_id", "row", "col", F.lit(1).alias("mask"))
    marked = px.join(keep, ["pair_id", "row", "col"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return R.mask_layer(marked).select("pair_id", "row", "col", "out_red", "out_green", "out_blue")


# shift by separable discrete Fourier transforms in plain SQL: an independent statement of phase correlation
_SHIFT = f"""
spx AS ({_PAIRS}), sdim AS (SELECT pair_id, max(row) + 1 AS h, max(col) + 1 AS w FROM spx GROUP BY 1),
g AS (SELECT pair_id, row, col, s, CASE s WHEN 1 THEN (red1 + green1 + blue1) / 3.0::DOUBLE ELSE (red2 + green2 + blue2) / 3.0::DOUBLE END AS x FROM spx, (VALUES (1), (2)) k(s)),
fr AS (SELECT pair_id, s, col, u, sum(x * cos(2 * pi() * ((u * row) % h) / h)) AS re, -sum(x * sin(2 * pi() * ((u * row) % h) / h)) AS im FROM g JOIN sdim USING (pair_id), LATERAL (SELECT unnest(range(h)) AS u) GROUP BY ALL),
fc AS (SELECT pair_id, s, u, v, sum(re * c + im * d) AS re, sum(im * c - re * d) AS im FROM (SELECT fr.*, v, cos(2 * pi() * ((v * col) % w) / w) AS c, sin(2 * pi() * ((v * col) % w) / w) AS d FROM fr JOIN sdim USING (pair_id), LATERAL (SELECT unnest(range(w)) AS v)) GROUP BY ALL),
cr AS (SELECT a.pair_id, a.u, a.v, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM fc a JOIN fc b ON a.pair_id = b.pair_id AND a.u = b.u AND a.v = b.v AND a.s = 1 AND b.s = 2),
nm AS (SELECT pair_id, u, v, re / (sqrt(re * re + im * im) + 1e-12) AS re, im / (sqrt(re * re + im * im) + 1e-12) AS im FROM cr),
ir AS (SELECT pair_id, v, y, sum(re * c - im * d) AS re, sum(im * c + re * d) AS im FROM (SELECT nm.*, y, cos(2 * pi() * ((u * y) % h) / h) AS c, sin(2 * pi() * ((u * y) % h) / h) AS d FROM nm JOIN sdim USING (pair_id), LATERAL (SELECT unnest(range(h)) AS y)) GROUP BY ALL),
ic AS (SELECT pair_id, y, x, sqrt(sum(re * c - im * d) ** 2 + sum(im * c + re * d) ** 2) AS mag FROM (SELECT ir.*, x, cos(2 * pi() * ((v * x) % w) / w) AS c, sin(2 * pi() * ((v * x) % w) / w) AS d FROM ir JOIN sdim USING (pair_id), LATERAL (SELECT unnest(range(w)) AS x)) GROUP BY ALL),
pk AS (SELECT pair_id, h, w, (y + h // 2) % h AS py, (x + w // 2) % w AS px, mag / (h * w) AS mag FROM ic JOIN sdim USING (pair_id)),
shift AS (SELECT pair_id, (py - h // 2)::DOUBLE AS shift_y, (px - w // 2)::DOUBLE AS shift_x FROM pk QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(mag, 9) DESC, py, px) = 1)"""


@query("R13", f"""WITH {_SHIFT} SELECT pair_id, shift_y, shift_x, round(sqrt(shift_x ** 2 + shift_y ** 2), 2) AS total_shift_pixels,
  round(greatest(0.0, least(1.0, 1.0 - sqrt(shift_x ** 2 + shift_y ** 2) / 5.0)), 4) AS registration_quality,
  round(CASE WHEN sqrt(shift_x ** 2 + shift_y ** 2) > 0.8 THEN least(1.0, sqrt(shift_x ** 2 + shift_y ** 2) / 3.0) ELSE 0.0 END, 4) AS edge_artifact_risk FROM shift""")
def shift_estimates(spark, d):
    return M.shift_estimates(R.pair_pixels(_t1(spark, d), _t2(spark, d)))


def _case_driver(p: str, dv: str, dw: str, db: str) -> str:
    return f"""CASE WHEN {p} = 0 THEN 'none' WHEN {dw} > 0.18 AND {dv} < -0.10 THEN 'water_inundation_or_flood' WHEN {dv} < -0.22 THEN 'vegetation_loss_or_clearing' WHEN {dv} > 0.22 THEN 'vegetation_greening'
  WHEN {db} > 0.15 AND {dv} < -0.05 THEN 'urban_construction_or_expansion' WHEN abs({dv}) < 0.08 AND abs({dw}) < 0.08 AND abs({db}) < 0.08 THEN 'illumination_or_texture_shift' ELSE 'unclassified_structural' END"""


_Q = """(SELECT pair_id, avg(CASE WHEN g > 230 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM (SELECT tile_id AS pair_id, (red + green + blue + nir) / 4.0::DOUBLE AS g FROM {t}) GROUP BY 1)"""
_DECIDE = """
season AS (SELECT *, CASE WHEN total_pixels > 0 THEN change_pixels::DOUBLE / total_pixels ELSE 0.0 END AS ratio, coalesce(least(greatest((mean_diff - 25.0::DOUBLE) / 90.0::DOUBLE, 0.0), 1.0), 0.0) AS s,
  CASE WHEN t1_date IS NULL OR t2_date IS NULL THEN 0 ELSE least(abs(dayofyear(t1_date) - dayofyear(t2_date)), 365 - abs(dayofyear(t1_date) - dayofyear(t2_date))) END AS doy FROM joined),
pen AS (SELECT *, CASE WHEN t1_date IS NULL OR t2_date IS NULL THEN 0.15 WHEN doy < 30 THEN 0.05 WHEN doy < 75 THEN 0.20 WHEN doy < 140 THEN 0.45 ELSE 0.70 END::DOUBLE AS penalty FROM season),
parts AS (SELECT *, CASE WHEN change_pixels = 0 THEN 0.70 WHEN driver IN ('none', 'illumination_or_texture_shift') THEN 0.35 ELSE 1.0 END::DOUBLE AS p,
  CASE WHEN ratio > 0.55 THEN greatest(penalty, 0.75) WHEN ratio > 0.30 THEN greatest(penalty, 0.45) ELSE penalty END::DOUBLE AS sv, CASE WHEN s > 0.4 THEN 0.80 ELSE 0.50 END::DOUBLE AS pers FROM pen),
scored AS (SELECT *, least(greatest(s * 0.35::DOUBLE + p * 0.25::DOUBLE + reg * 0.15::DOUBLE + pers * 0.15::DOUBLE + sv * -0.10::DOUBLE + cloud * -0.10::DOUBLE, 0.05), 0.98) AS f FROM parts),
decided AS (SELECT *, CASE WHEN f >= 0.72 THEN 'HIGH' WHEN f >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS label,
  CASE WHEN ratio * 100 < 1.0 OR round(f, 4) < 0.3 THEN NULL WHEN ratio * 100 > 15 THEN 'major_change' WHEN ratio * 100 > 5 THEN 'moderate_change' ELSE 'minor_change' END AS change_type FROM scored)"""


@query("C12 C1 C2 C3 C5 C6 C7 C8 C9 C10 R3", f"""WITH RECURSIVE {_FACTS}, {_SHIFT},
joined AS (SELECT p.*, f.* EXCLUDE (pair_id), {_case_driver('f.change_pixels', 'f.dv', 'f.dw', 'f.db')} AS driver, greatest(round(q1.c, 4), round(q2.c, 4)) AS cloud,
  round(greatest(0.0, least(1.0, 1.0 - sqrt(shift_x ** 2 + shift_y ** 2) / 5.0)), 4) AS reg
  FROM v_pixel_pairs p JOIN facts f USING (pair_id) JOIN {_Q.format(t='v_pixels')} q1 USING (pair_id) JOIN {_Q.format(t='v_pixels_t2')} q2 USING (pair_id) JOIN shift USING (pair_id)),
{_DECIDE}
SELECT pair_id, t1_tile_id, t2_tile_id, 'chg-' || sha256(tile_id || '|' || t1_tile_id || '|' || t2_tile_id) AS analysis_id, change_pixels, total_pixels, region_count, round(ratio * 100, 2) AS change_percentage,
  round(s, 4) AS structural, round(p, 4) AS spectral_confirmation, round(sv, 4) AS seasonal_confound, round(cloud, 4) AS cloud_contamination, round(reg, 4) AS registration_quality, pers AS persistence, doy::INT AS doy_diff_days,
  round(f, 4) AS final_score, label, change_type, CASE WHEN change_pixels > 0 THEN driver ELSE 'structural' END AS spectral_driver, 'completed' AS status FROM decided""")
def change_analyses(spark, d):
    out = P.analyze_pairs(v.pixel_pairs(spark, d), _t1(spark, d), _t2(spark, d))
    return out.select(
        "pair_id", "t1_tile_id", "t2_tile_id", "analysis_id", "change_pixels", "total_pixels", "region_count", "change_percentage", "structural", "spectral_confirmation", "seasonal_confound",
        "cloud_contamination", "registration_quality", "persistence", "doy_diff_days", "final_score", "label", "change_type", "spectral_driver", "status",
    )


_FAKE = """
fake AS (SELECT o_orderkey AS pair_id, o_totalprice % 100 AS x, o_orderkey % 11 = 3 AS broken, (o_orderkey % 700)::BIGINT AS change_pixels, 1024::BIGINT AS total_pixels,
  CASE WHEN o_orderkey % 700 > 0 THEN (o_orderkey % 150)::DOUBLE END AS mean_diff, CASE WHEN o_orderkey % 700 > 0 THEN (o_orderkey % 61 - 30) / 100.0::DOUBLE ELSE 0.0 END AS dv,
  CASE WHEN o_orderkey % 700 > 0 THEN (o_orderkey % 53 - 26) / 100.0::DOUBLE ELSE 0.0 END AS dw, CASE WHEN o_orderkey % 700 > 0 THEN (o_orderkey % 47 - 23) / 100.0::DOUBLE ELSE 0.0 END AS db,
  o_orderdate::DATE AS t1_date, CASE WHEN o_orderkey % 13 <> 5 THEN o_orderdate::DATE + (o_orderkey % 366)::INT END AS t2_date, (o_orderkey % 101) / 100.0::DOUBLE AS cloud1, (o_orderkey % 17) / 17.0::DOUBLE AS cloud2,
  CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 6) / 5.0::DOUBLE END AS registration, 0.8::DOUBLE AS quality1, (o_orderkey % 10) / 10.0::DOUBLE AS quality2 FROM orders)"""


@query("C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C14", f"""WITH {_FAKE},
joined AS (SELECT *, {_case_driver('change_pixels', 'dv', 'dw', 'db')} AS driver, greatest(cloud1, cloud2) AS cloud, coalesce(registration, least(quality1, quality2)) AS reg FROM fake),
{_DECIDE}
SELECT pair_id, CASE WHEN broken THEN 0.0 ELSE round(f, 4) END AS final_score, CASE WHEN broken THEN 'ERROR' ELSE label END AS label, CASE WHEN NOT broken THEN change_type END AS change_type,
  CASE WHEN broken THEN 'structural' WHEN change_pixels > 0 THEN driver ELSE 'structural' END AS spectral_driver, CASE WHEN broken THEN 'error' ELSE 'completed' END AS status,
  CASE WHEN broken THEN 0.0 ELSE round(sv, 4) END AS seasonal_confound, CASE WHEN broken THEN 0 ELSE doy END::INT AS doy_diff_days, CASE WHEN broken THEN 'SUPPRESSED' WHEN label = 'HIGH' THEN 'READY' WHEN label = 'MEDIUM' THEN 'NEEDS REVIEW' ELSE 'SUPPRESSED' END AS gate,
  CASE WHEN broken OR change_pixels = 0 THEN '' WHEN driver = 'water_inundation_or_flood' THEN 'Flood/water inundation verified by strong NDWI increase (+' || printf('%.2f', dw) || ') and vegetation decline (' || printf('%.2f', dv) || ').'
    WHEN driver = 'vegetation_loss_or_clearing' THEN 'Vegetation canopy loss/clearing verified by significant NDVI decline (' || printf('%.2f', dv) || ').'
    WHEN driver = 'vegetation_greening' THEN 'Vegetation growth/greening verified by significant NDVI increase (+' || printf('%.2f', dv) || ').'
    WHEN driver = 'urban_construction_or_expansion' THEN 'Built-up / infrastructure expansion verified by high built-up index (+' || printf('%.2f', db) || ').'
    WHEN driver = 'illumination_or_texture_shift' THEN 'Low spectral index shift across changed region; indicates possible illumination or shadow variation.' ELSE 'Structural change detected.' END AS spectral_description FROM decided""")
def confidence_rules(spark, d):
    """Every decision rule over facts spread across all thresholds."""
    k = F.col("o_orderkey")
    has = k % 700 > 0
    part = lambda m, off: F.when(has, (k % m - off) / 100.0)
    facts = v.table(spark, d, "orders").select(
        k.alias("pair_id"), F.when(k % 11 != 3, k % 700).alias("change_pixels"), F.when(k % 11 != 3, F.lit(1024).cast("bigint")).alias("total_pixels"),
        F.when(has, (k % 150).cast("double")).alias("mean_masked_diff"), part(61, 30).alias("delta_ndvi"), part(53, 26).alias("delta_ndwi"), part(47, 23).alias("delta_ndbi"),
        F.to_date("o_orderdate").alias("t1_date"), F.when(k % 13 != 5, F.date_add(F.to_date("o_orderdate"), (k % 366).cast("int"))).alias("t2_date"),
        ((k % 101) / 100.0).alias("cloud1"), ((k % 17) / 17.0).alias("cloud2"), F.when(k % 3 > 0, (k % 6) / 5.0).alias("registration"),
        F.lit(0.8).alias("quality1"), ((k % 10) / 10.0).alias("quality2"),
    )
    out = C.decide(facts)
    return out.select("pair_id", "final_score", "label", "change_type", "spectral_driver", "status", "seasonal_confound", "doy_diff_days",
                      C.trust_gate(F.col("label")).alias("gate"), "spectral_description")


@query("F6", """
SELECT tile_id, c AS cloud_fraction FROM (SELECT tile_id, round(avg(CASE WHEN (red + green + blue + nir) / 4.0 > 230 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS c FROM v_pixels GROUP BY 1) WHERE c * 100 < 4.0""")
def clear_tiles(spark, d):
    from orbitloom.operators.filters import metadata_filter

    return metadata_filter(R.quality(v.pixels(spark, d), ["tile_id"]), max_cloud=4.0).select("tile_id", "cloud_fraction")


# ---- how far back the images of a site differ from its latest one

_SIGHTS = """
sights AS (SELECT DISTINCT tile // 6 AS site, tile_id || '_a' AS obs_id, DATE '2024-01-01' + tile * 9 AS date FROM v_pixels
  UNION ALL SELECT DISTINCT tile // 6, tile_id || '_b', DATE '2024-01-01' + (tile * 9 + 5) FROM v_pixels_t2 WHERE tile % 6 = 4),
shots AS (SELECT * REPLACE (tile_id || '_a' AS tile_id) FROM v_pixels WHERE tile % 5 <> 2 UNION ALL SELECT * REPLACE (tile_id || '_b' AS tile_id) FROM v_pixels_t2 WHERE tile % 6 = 4),
line AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date DESC, obs_id DESC) AS back, count(*) OVER (PARTITION BY site) AS n FROM sights),
last AS (SELECT site, obs_id AS ref, date AS last_date, n, obs_id IN (SELECT tile_id FROM shots) AS last_image FROM line WHERE back = 1),
matched AS (SELECT l.obs_id AS pair_id, l.site, l.date, l.back, r.ref FROM line l JOIN last r ON l.site = r.site WHERE l.back > 1 AND r.last_image AND l.obs_id IN (SELECT tile_id FROM shots))"""
_SHOT_PAIRS = "SELECT m.pair_id, a.tile, a.row, a.col, " + ", ".join(f"a.{b} AS {b}1, b.{b} AS {b}2" for b in _BANDS) + \
    " FROM matched m JOIN shots a ON a.tile_id = m.pair_id JOIN shots b ON b.tile_id = m.ref AND a.row = b.row AND a.col = b.col"


@query("W3 C12", f"""WITH RECURSIVE {_SIGHTS}, {_FACTS.replace(_PAIRS, _SHOT_PAIRS)},
walk AS (SELECT m.site, m.date, min(CASE WHEN round(100.0::DOUBLE * change_pixels / total_pixels, 2) > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY m.site ORDER BY m.back ROWS UNBOUNDED PRECEDING) AS still
  FROM matched m LEFT JOIN facts USING (pair_id))
SELECT l.site, l.n AS observations, count(w.date) FILTER (w.still = 1) AS run_length,
  CASE WHEN l.n >= 2 AND l.last_image THEN coalesce(min(w.date) FILTER (w.still = 1), l.last_date)::DATE::VARCHAR END AS earliest_supported
FROM last l LEFT JOIN walk w ON l.site = w.site GROUP BY l.site, l.n, l.last_image, l.last_date""")
def earliest_supported_pixels(spark, d):
    """Six tiles are the dates of one site; one in five has no image, and a later image of the fifth tile is one more date."""
    old, new = v.pixels(spark, d), v.pixels_t2(spark, d).where("tile % 6 = 4")
    sight = lambda px, end, days: px.select("tile", "tile_id").distinct().select(
        F.floor(F.col("tile") / 6).alias("site"), F.concat("tile_id", F.lit(end)).alias("obs_id"), F.concat("tile_id", F.lit(end)).alias("tile_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("tile") * 9 + days).alias("date"))
    shot = lambda px, end: px.withColumn("tile_id", F.concat("tile_id", F.lit(end)))
    out = P.earliest_supported_pixels(sight(old, "_a", 0).unionByName(sight(new, "_b", 5)), shot(old.where("tile % 5 <> 2"), "_a").unionByName(shot(new, "_b")))
    return out.select("site", "observations", "run_length", F.col("earliest_supported").cast("string").alias("earliest_supported"))

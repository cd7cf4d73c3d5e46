"""Pixel operators on long tables (tile, row, col, red, green, blue, nir).

A tile holds a bounded number of pixels, so grouping by tile or pair is safe.
Chains keep one partitioning: pixels are hash-partitioned by tile or pair once and
every later aggregate and window contains that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import spectral as S
from ..functions.common import clamp

BANDS = ("red", "green", "blue", "nir")


def band_mean(bands: list[Column]) -> Column:
    """Mean over the bands that are present."""
    present = [F.when(b.isNotNull(), 1).otherwise(0) for b in bands]
    return sum((F.coalesce(b.cast("double"), F.lit(0.0)) for b in bands), F.lit(0.0)) / sum(present, F.lit(0))


def harmonise(pixels: DataFrame, band_count: str = "band_count") -> DataFrame:
    """One band is repeated to three, two get a zero third, a fourth is kept when present."""
    n = F.col(band_count)
    return pixels.withColumns({
        "green": F.when(n == 1, F.col("red")).otherwise(F.col("green")),
        "blue": F.when(n == 1, F.col("red")).when(n == 2, F.lit(0).cast(pixels.schema["blue"].dataType)).otherwise(F.col("blue")),
        "nir": F.when(n >= 4, F.col("nir")),
    })


def stretch(pixels: DataFrame, tile: str = "tile_id", bands=("red", "green", "blue")) -> DataFrame:
    """Non-8-bit pixels to 0-255 by the 2nd and 98th percentile of a tile's positive values; a flat tile gives 0."""
    values = pixels.select(tile, F.explode(F.array(*[F.col(b) for b in bands])).alias("_v")).where(F.col("_v") > 0)
    cuts = values.groupBy(tile).agg(F.percentile("_v", F.array(F.lit(0.02), F.lit(0.98))).alias("_q")).select(
        tile, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi")
    )
    scaled = lambda b: F.when(
        F.coalesce(F.col("_hi") > F.col("_lo"), F.lit(False)),
        F.floor(clamp((F.col(b) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255, 0, 255)),
    ).otherwise(F.lit(0)).cast("int")
    return pixels.join(cuts, tile, "left").withColumns({b: scaled(b) for b in bands}).drop("_lo", "_hi")


def quality_aggregates(bands: list[str], tag: str = "") -> list[Column]:
    """The sums behind `quality_columns`, usable inside a larger aggregate."""
    cols = [F.col(b) for b in bands]
    gray = band_mean(cols)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    saturated = F.greatest(*[F.coalesce(c, F.lit(0)) for c in cols]) >= 250
    return [
        share(gray > 230).alias("_c" + tag), share(gray < 15).alias("_d" + tag), share(saturated).alias("_s" + tag),
        F.percentile(gray, F.array(F.lit(0.02), F.lit(0.98))).alias("_q" + tag),
    ]


def quality_columns(tag: str = "") -> list[Column]:
    c, d, s, q = (F.col(x + tag) for x in ("_c", "_d", "_s", "_q"))
    span = q[1] - q[0]
    low = F.when(span < 50, 0.2).otherwise(0.0)
    return [
        F.round(c, 4).alias("cloud_fraction" + tag), F.round(d, 4).alias("dark_fraction" + tag), F.round(span, 2).alias("dynamic_range" + tag),
        F.round(s, 4).alias("saturation_fraction" + tag),
        F.round(clamp(F.lit(1.0) - c * 0.5 - d * 0.3 - s * 0.2 - low, 0.0, 1.0), 4).alias("overall_quality" + tag),
    ]


def quality(pixels: DataFrame, keys: list[str], bands=BANDS) -> DataFrame:
    """Cloud, dark and saturated shares, dynamic range and overall quality per tile, in one aggregate."""
    return pixels.groupBy(*keys).agg(*quality_aggregates(list(bands))).select(*keys, *quality_columns())


def quality_or_worst(tiles: DataFrame, per_tile: DataFrame, keys: list[str]) -> DataFrame:
    """Quality of every listed tile; one without pixels gets the worst case."""
    worst = {"cloud_fraction": 1.0, "dark_fraction": 1.0, "dynamic_range": 0.0, "saturation_fraction": 1.0, "overall_quality": 0.0}
    return tiles.join(per_tile, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in worst.items()})


def indices(pixels: DataFrame) -> DataFrame:
    args = [F.col(b).cast("double") for b in BANDS]
    return pixels.withColumns({"ndvi": S.ndvi(*args), "ndwi": S.ndwi(*args), "ndbi": S.ndbi(*args)})


def pair_pixels(t1: DataFrame, t2: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Same-position pixels of both dates; the inner join is the crop to the common area.

    Both sides are partitioned by the pair alone, which this join and every later
    per-pair step accept, so the pixels move once.
    """
    left = t1.select(pair, "row", "col", *[F.col(b).alias(b + "1") for b in BANDS]).repartition(pair)
    right = t2.select(pair, "row", "col", *[F.col(b).alias(b + "2") for b in BANDS]).repartition(pair)
    both = left.join(right, [pair, "row", "col"])
    has_nir = F.col("nir1").isNotNull() & F.col("nir2").isNotNull()
    return both.withColumn("nir1", F.when(has_nir, F.col("nir1"))).withColumn("nir2", F.when(has_nir, F.col("nir2")))


def histogram_maps(pairs: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Per (pair, band, t2 value): the t1 value at the same cumulative share, interpolated, clamped at the ends.

    Works on at most 256 value counts per side, never on pixels against pixels.
    """
    sides = F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.lit(side).alias("side"), F.col(f"{b}{side}").alias("v"))
        for b in BANDS for side in (1, 2)
    ])).alias("s")
    counts = (
        pairs.select(pair, sides).select(pair, "s.*").where(F.col("v").isNotNull())
        .withColumn("v", F.least(F.greatest(F.col("v").cast("int"), F.lit(0)), F.lit(255)))
        .groupBy(pair, "band", "side", "v").agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy(pair, "band", "side").orderBy("v")
    cdf = counts.withColumn(
        "cdf", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        / F.sum("n").over(Window.partitionBy(pair, "band", "side"))
    )
    # one sweep over both distributions in cdf order finds the bracketing t1 entries of every t2 entry:
    # the last t1 entry at or below it and the first one at or above it
    ref = F.when(F.col("side") == 1, F.struct("cdf", "v"))
    up = Window.partitionBy(pair, "band").orderBy("cdf", "side")
    down = Window.partitionBy(pair, "band").orderBy(F.col("cdf").desc(), F.col("side"))
    swept = cdf.withColumn("lo", F.last(ref, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "hi", F.last(ref, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    )
    slope = (F.col("hi.v") - F.col("lo.v")) / (F.col("hi.cdf") - F.col("lo.cdf"))
    mapped = (
        F.when(F.col("lo").isNull(), F.col("hi.v").cast("double"))
        .when(F.col("hi").isNull(), F.col("lo.v").cast("double"))
        .when(F.col("hi.cdf") == F.col("lo.cdf"), F.col("lo.v").cast("double"))
        .otherwise(F.col("lo.v") + slope * (F.col("cdf") - F.col("lo.cdf")))
    )
    return swept.where(F.col("side") == 2).select(pair, "band", "v", mapped.alias("mapped"))


def match_histograms(pairs: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Add `red2m` ... : t2 bands matched to t1.  The value maps join back as one row per pair."""
    maps = histogram_maps(pairs, pair)
    per_pair = maps.groupBy(pair).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("band") == b, F.struct("v", "mapped")))).alias("_m_" + b) for b in BANDS
    ])
    value = lambda b: F.least(F.greatest(F.col(b + "2").cast("int"), F.lit(0)), F.lit(255))
    joined = pairs.join(per_pair, pair)
    return joined.withColumns({
        b + "2m": F.when(F.col(b + "2").isNotNull(), F.try_element_at("_m_" + b, value(b))) for b in BANDS
    }).drop(*["_m_" + b for b in BANDS])


def difference(pairs: DataFrame) -> DataFrame:
    """Mean absolute band difference of matched t2 and t1."""
    return pairs.withColumn("diff", band_mean([F.abs(F.col(b + "2m") - F.col(b + "1")) for b in BANDS]))


def threshold(pairs: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Adaptive threshold max(mean + 2 std, 30) per pair and the raw mask."""
    w = Window.partitionBy(pair)
    thr = F.greatest(F.avg("diff").over(w) + F.stddev_pop("diff").over(w) * 2.0, F.lit(30.0))
    return pairs.withColumn("threshold", thr).withColumn("raw_mask", (F.col("diff") > F.col("threshold")).cast("int"))


def mask_layer(pixels: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Display layer: scaled difference in red inside the mask, a faint green outside."""
    top = F.max("diff").over(Window.partitionBy(pair))
    inside = F.col("mask") > 0
    return pixels.withColumns({
        "out_red": F.when(inside & (top > 0), F.floor(F.col("diff") / top * 255)).otherwise(0).cast("int"),
        "out_green": F.when(inside, 0).otherwise(50).cast("int"),
        "out_blue": F.lit(0),
    })


def texture(pixels: DataFrame, tile: str = "tile_id", size: int = 16) -> DataFrame:
    """Local standard deviation of brightness in a size x size window with mirrored borders.

    The border is mirrored by giving edge pixels extra positions; the window sum is
    then two sliding sums, along rows and along columns.
    """
    before, after = size // 2, size - size // 2 - 1
    w = Window.partitionBy(tile)
    df = pixels.withColumn("_b", (F.col("red") + F.col("green") + F.col("blue")) / (3.0 * 255.0)).withColumns({
        "_h": F.max("row").over(w) + 1, "_w": F.max("col").over(w) + 1,
    })

    def mirrored(at: str, length: str) -> Column:
        c, n = F.col(at), F.col(length)
        turns = F.sequence(F.lit(-1) - F.floor(F.lit(size) / n).cast("int"), F.lit(1) + F.floor(F.lit(size) / n).cast("int"))
        same = F.transform(turns, lambda t: c + t * n * 2)
        flipped = F.transform(turns, lambda t: n * 2 * t + n * 2 - 1 - c)
        return F.filter(F.concat(same, flipped), lambda p: (p >= -before) & (p < n + after))

    cols = df.select(tile, "row", F.explode(mirrored("col", "_w")).alias("_x"), "_b", "_h", "_w")
    along = Window.partitionBy(tile, "row").orderBy("_x").rangeBetween(-before, after)
    row_sums = cols.select(
        tile, "row", F.col("_x").alias("col"), "_h", "_w", F.sum("_b").over(along).alias("_s"),
        F.sum(F.col("_b") * F.col("_b")).over(along).alias("_ss"), F.count("*").over(along).alias("_n"),
    ).where((F.col("col") >= 0) & (F.col("col") < F.col("_w")))
    rows = row_sums.select(tile, "col", F.explode(mirrored("row", "_h")).alias("row"), "_h", "_s", "_ss", "_n")
    down = Window.partitionBy(tile, "col").orderBy("row").rangeBetween(-before, after)
    n = F.sum("_n").over(down)
    mean, mean_sq = F.sum("_s").over(down) / n, F.sum("_ss").over(down) / n
    local = rows.select(
        tile, "row", "col", "_h", F.sqrt(F.greatest(mean_sq - mean * mean, F.lit(0.0))).alias("texture")
    ).where((F.col("row") >= 0) & (F.col("row") < F.col("_h"))).drop("_h")
    return pixels.join(local, [tile, "row", "col"])


def index_summary(pixels: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Twelve statistics per tile over its valid pixels (brighter than 0.02, or all if none is)."""
    r, g, b = (F.col(x) / 255.0 for x in ("red", "green", "blue"))
    nir = F.coalesce(F.col("nir") / 255.0, clamp(g * 0.5 + r * 0.3 - b * 0.2 + 0.2, 0.0, 1.0))
    df = texture(pixels, tile).withColumns({"_r": r, "_g": g, "_bl": b, "_n": nir})
    df = df.withColumns({
        "_ndvi": (F.col("_n") - F.col("_r")) / (F.col("_n") + F.col("_r") + F.lit(1e-8)),
        "_ndwi": (F.col("_g") - F.col("_n")) / (F.col("_g") + F.col("_n") + F.lit(1e-8)),
        "_bsi": ((F.col("_r") + F.col("_bl")) - (F.col("_g") + F.col("_n")))
        / (F.abs((F.col("_bl") + F.col("_n")) - (F.col("_r") + F.col("_g")) + F.lit(1e-8)) + F.lit(1e-8)),
        "_br": (F.col("_r") + F.col("_g") + F.col("_bl")) / 3.0,
    })
    lit = F.col("_br") > 0.02
    w = Window.partitionBy(tile)
    df = df.withColumn("_lit", F.sum(lit.cast("int")).over(w)).withColumn("_all", F.count("*").over(w))
    df = df.where(lit | (F.col("_lit") == 0))
    return df.groupBy(tile).agg(
        F.avg("_ndvi").alias("ndvi_mean"), F.stddev_pop("_ndvi").alias("ndvi_std"),
        F.percentile("_ndvi", F.lit(0.95)).alias("ndvi_max"), F.avg("_ndwi").alias("ndwi_mean"),
        F.avg("_bsi").alias("bsi_mean"), F.avg("_br").alias("brightness_mean"),
        F.stddev_pop("_br").alias("brightness_std"), F.avg("texture").alias("texture_mean"),
        F.avg("_r").alias("red_mean"), F.avg("_g").alias("green_mean"), F.avg("_bl").alias("blue_mean"),
        (F.count("*") / F.max("_all")).alias("valid_pixel_ratio"),
    )


def pixel_stats(pixels: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Mean, std, percentiles, range and valid share of pixel brightness per tile."""
    df = pixels.withColumn("_v", (F.col("red") + F.col("green") + F.col("blue")) / 3.0)
    return df.groupBy(tile).agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.percentile("_v", F.array(F.lit(0.02), F.lit(0.95), F.lit(0.98))).alias("_q"),
        F.avg(F.when(F.col("_v") / 255.0 > 0.02, 1.0).otherwise(0.0)).alias("valid_ratio"),
    ).select(tile, "mean", "std", "min", "max", F.col("_q")[0].alias("p2"), F.col("_q")[1].alias("p95"),
             F.col("_q")[2].alias("p98"), "valid_ratio")


def augment(pixels: DataFrame, seed: int, tile: str = "tile_id", intensity: float = 0.1, offset: float = 10.0) -> DataFrame:
    """Quarter turns, flips and per-band gain and offset, drawn per tile from a seeded hash."""
    def draw(name: str) -> Column:
        h = F.md5(F.concat_ws("|", F.col(tile).cast("string"), F.lit(name), F.lit(str(seed))))
        return F.conv(F.substring(h, 1, 6), 16, 10).cast("double") / 16777216.0

    w = Window.partitionBy(tile)
    df = pixels.withColumns({
        "_h": F.max("row").over(w) + 1, "_w": F.max("col").over(w) + 1, "_k": F.floor(draw("turn") * 4).cast("int"),
    })
    r, c, h, wd, k = (F.col(x) for x in ("row", "col", "_h", "_w", "_k"))
    df = df.withColumns({
        "_r2": F.when(k == 0, r).when(k == 1, wd - 1 - c).when(k == 2, h - 1 - r).otherwise(c),
        "_c2": F.when(k == 0, c).when(k == 1, r).when(k == 2, wd - 1 - c).otherwise(h - 1 - r),
        "_h2": F.when(k % 2 == 0, h).otherwise(wd), "_w2": F.when(k % 2 == 0, wd).otherwise(h),
    })
    jitter = draw("jitter") > 0.3
    shift = (draw("offset") * 2 - 1) * offset

    def band(b: str) -> Column:
        gained = clamp(F.col(b) * (1 + (draw("gain_" + b) * 2 - 1) * intensity), 0, 255)
        return F.when(jitter, F.floor(clamp(gained + shift, 0, 255))).otherwise(F.col(b)).cast("int")

    return df.select(
        tile,
        F.when(draw("flip_v") > 0.5, F.col("_h2") - 1 - F.col("_r2")).otherwise(F.col("_r2")).cast("int").alias("row"),
        F.when(draw("flip_h") > 0.5, F.col("_w2") - 1 - F.col("_c2")).otherwise(F.col("_c2")).cast("int").alias("col"),
        *[band(b).alias(b) for b in ("red", "green", "blue")],
    )


def band_view(pixels: DataFrame, view: str) -> DataFrame:
    """Display bands: `rgb`, `cir` (near-infrared, red, green), `ndvi` or `ndwi` (scaled to 0-255)."""
    if view == "rgb":
        return pixels.select("tile_id", "row", "col", "red", "green", "blue")
    if view == "cir":
        return pixels.select("tile_id", "row", "col", F.col("nir").alias("red"), F.col("red").alias("green"), F.col("green").alias("blue"))
    scaled = F.floor((F.col(view) + 1) * 127.5).cast("int")
    return indices(pixels).select("tile_id", "row", "col", scaled.alias("level"))

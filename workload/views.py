"""The driver's tables seen as an imagery archive (Spark side; `duck_views` is the SQL side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitloom.sources.tables import spread

# scene name by label; label 9 is undated
SCENE_NAMES = (
    "SUNDARBANS_MANGROVE", "COASTAL_AGRICULTURE", "URBAN_INDUSTRIAL_HUB", "MUMBAI_PORT_COAST", "GUWAHATI",
    "BRAHMAPUTRA", "FOREST_WATERSHED", "BHADLA_SOLAR_PARK", "FARMLAND", "PLATEAU",
)
THEMES = (
    "flood damage", "urban buildings", "dense forest canopy", "photovoltaic solar panels", "mangrove delta",
    "river and surrounding vegetation", "airport runway",
)
PLACES = ("assam", "mumbai", "kerala", "delhi ncr", "guwahati")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(index: Column, values) -> Column:
    """values[index], as a `when` chain over a fixed list."""
    return reduce(lambda acc, iv: acc.when(index == iv[0], F.lit(iv[1])), list(enumerate(values))[1:], F.when(index == 0, F.lit(values[0])))


def tile_name(number: Column) -> Column:
    """tile_ and the number, of five digits at least."""
    text = number.cast("string")
    return F.concat(F.lit("tile_"), F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0")))


def scenes(spark, d):
    label = table(spark, d, "embeddings").select("label").distinct()
    at = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    return label.select(
        F.concat(F.lit("scene_"), F.col("label").cast("string"), F.lit("_"), pick(F.col("label"), SCENE_NAMES)).alias("scene_id"),
        pick(F.col("label") % 3, ("Sentinel-2", "Landsat-8", "Sentinel-1")).alias("sensor"),
        F.when(F.col("label") != 9, F.date_add(F.lit("2024-01-15").cast("date"), F.col("label") * 30)).alias("acquisition_date"),
        F.date_add(at.cast("date"), F.col("label") % 4).cast("timestamp").alias("ingested_at"),
    )


def tiles(spark, d):
    e = table(spark, d, "embeddings")
    x, y = F.col("vec_id") % 20, F.floor(F.col("vec_id") / 20.0)
    lon, lat = F.lit(91.60) + F.lit(0.02) * x, F.lit(26.05) + F.lit(0.02) * y
    return e.select(
        tile_name(F.col("vec_id")).alias("tile_id"),
        F.concat(F.lit("scene_"), F.col("label").cast("string"), F.lit("_"), pick(F.col("label"), SCENE_NAMES)).alias("scene_id"),
        x.cast("int").alias("x_index"), y.cast("int").alias("y_index"), F.round(lon, 4).alias("center_lon"), F.round(lat, 4).alias("center_lat"),
        F.round(lon - 0.01, 4).alias("bounds_minx"), F.round(lat - 0.01, 4).alias("bounds_miny"),
        F.round(lon + 0.01, 4).alias("bounds_maxx"), F.round(lat + 0.01, 4).alias("bounds_maxy"),
        "embedding", "label", "vec_id",
    )


def headers(spark, d):
    """Scene file headers from orders; names cover every sensor and date form."""
    o = spread(table(spark, d, "orders"))
    k = F.col("o_orderkey")
    fmt = lambda f: F.date_format("o_orderdate", f)
    s = k.cast("string")
    names = [
        F.concat(F.lit("S2A_MSIL2A_"), fmt("yyyyMMdd"), F.lit("_T"), s, F.lit(".tif")),
        F.concat(F.lit("S1B_IW_GRD_"), fmt("yyyy-MM-dd"), F.lit("_"), s, F.lit(".tiff")),
        F.concat(F.lit("LC08_L1TP_"), fmt("yyyyMMdd"), F.lit("_"), s, F.lit(".TIF")),
        F.concat(F.lit("landsat 9 scene "), fmt("yyyy_MM_dd"), F.lit(" "), s, F.lit(".tif")),
        F.concat(F.lit("MOD09_"), fmt("yyyyMMdd"), F.lit("."), s, F.lit(".geotiff")),
        F.concat(F.lit("planet_psscene_x"), s, F.lit("x.tif")),
        F.concat(F.lit("aerial-"), fmt("yyyy-MM-dd"), F.lit("-x"), s, F.lit(".png")),
        F.concat(F.lit("sentinel2_x"), s, F.lit("_20240230.tif")),
        F.concat(F.lit("L9_"), fmt("yyyyMMdd"), F.lit("_x"), s, F.lit(".tif")),
        F.concat(F.lit("MYD11_"), fmt("yyyyMMdd"), F.lit("_x"), s, F.lit(".tif")),
        F.concat(F.lit("survey_x"), s, F.lit(".jp2")),
        F.concat(F.lit("S2_x"), fmt("yyyy_MM_dd"), F.lit("_x"), s, F.lit(".tif")),
    ]
    kind, utm = k % 12, k % 11 == 5
    name = reduce(lambda acc, iv: acc.when(kind == iv[0], iv[1]), list(enumerate(names))[1:], F.when(kind == 0, names[0]))
    df = o.select(
        k.alias("header_key"), F.concat(F.lit("/raw/"), F.col("o_orderstatus"), F.lit("/"), name).alias("file_path"),
        (k % 97 != 13).alias("present"), (k % 89 != 7).alias("readable"),
        F.when(k % 11 == 5, F.when(k % 2 == 0, "EPSG:32646").otherwise("EPSG:32719")).when(k % 11 == 8, "EPSG:3857").when(k % 7 != 3, "EPSG:4326").alias("crs"),
        F.when(k % 50 == 1, 0).otherwise(100 + (k * 37) % 1400).cast("int").alias("width"),
        (100 + (k * 53) % 1100).cast("int").alias("height"), (k % 5).cast("int").alias("band_count"),
        F.when(utm, F.lit(300000.0) + (k % 300) * F.lit(1000.0)).otherwise(F.lit(60.0) + (k % 300) * F.lit(0.1)).alias("bounds_minx"),
        F.when(utm, F.lit(2800000.0) + (k % 250) * F.lit(1000.0)).otherwise(F.lit(8.0) + (k % 250) * F.lit(0.1)).alias("bounds_miny"),
        F.when(k % 6 == 2, "Override-1").when(k % 6 == 4, "").alias("sensor_given"),
        F.when(k % 8 == 3, "2020-02-02").alias("date_given"),
    )
    pixel = F.when(F.col("crs").startswith("EPSG:32"), F.lit(10.0)).otherwise(F.lit(0.0001))
    return df.withColumn("bounds_maxx", F.col("bounds_minx") + F.col("width") * pixel).withColumn(
        "bounds_maxy", F.col("bounds_miny") + F.col("height") * pixel
    )


def queries(spark, d):
    """Query texts from orders: eleven phrasings that reach every extraction rule."""
    o = spread(table(spark, d, "orders"))
    k = F.col("o_orderkey")
    o = o.withColumns({"_t": pick(k % 7, THEMES), "_p": pick(k % 5, PLACES)})
    t, p, n = F.col("_t"), F.col("_p"), (k % 50).cast("string")
    c = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    texts = [
        c("show ", t, " in ", p, " between january and august 2024 with cloud cover < ", n, "%"),
        c("Find locations similar to ", t),
        c("what has changed around ", p, " since ", F.date_format("o_orderdate", "yyyy-MM-dd")),
        c("Where did this data come from: provenance of ", t),
        c("describe the land cover visible in ", p),
        c("locate ", t, " from 2024-02-01 to 2024-09-30 sentinel-2"),
        c(t, " [91.60, 26.00, 91.80, 26.30]"),
        c("show me ", t, " during march 2024 landsat"),
        c("search for ", t, " near ", p, " after 2024-03-01"),
        c("  ", t, " "),
        c("find ", t, " sar imagery across ", p, " between foo and bar with cloud under ", n, "%"),
    ]
    kind = k % 11
    text = reduce(lambda acc, iv: acc.when(kind == iv[0], iv[1]), list(enumerate(texts))[1:], F.when(kind == 0, texts[0]))
    return o.select(
        F.concat(F.lit("q-"), k.cast("string")).alias("query_id"), text.alias("text"),
        F.when(k % 4 == 0, tile_name(F.floor(k / 4))).alias("tile_id"),
        F.when(k % 9 == 4, "Landsat-8").alias("sensor_given"),
    )


# block position (first and last row and column) and band levels of both dates, by tile kind (tile % 4)
BLOCKS = {0: ((6, 13), (17, 24)), 1: ((8, 17),), 2: ((8, 17),), 3: ()}
LEVELS = {
    0: {"red": ("low", "high"), "green": ("low", "high"), "blue": ("low", "high"), "nir": ("low", "high")},
    1: {"red": ("low", "high"), "green": ("mid", "mid"), "blue": ("low", "high"), "nir": ("high", "low")},
    2: {"red": ("mid", "mid"), "green": ("low", "high"), "blue": ("low", "high"), "nir": ("high", "low")},
}
NOISE = {"red": 1, "green": 3, "blue": 5, "nir": 7}


def _pixels(spark, d, date: int):
    """32 x 32 tiles cut from events, four bands; the last tile may be shorter.

    A bright stripe on top, a dark one below, and blocks that change between the
    dates: brighter (kind 0), lost vegetation (1), flood (2), nothing (3).
    """
    e = table(spark, d, "events")
    at = F.col("event_id")
    px = e.select(
        F.floor(at / 1024.0).cast("int").alias("tile"), F.floor((at % 1024) / 32.0).cast("int").alias("row"), (at % 32).cast("int").alias("col"),
        *[(F.floor(F.col("value") * m).cast("int") % 10).alias(b) for b, m in NOISE.items()],
    )
    kind, row, c = F.col("tile") % 4, F.col("row"), F.col("col")

    def band(b: str) -> Column:
        n = F.col(b)
        level = {"low": n + 20, "mid": n * 3 + 90, "high": n % 6 + 250}
        out = F.when(row < 4, n + 225).when(row >= 28, n)
        for k, areas in BLOCKS.items():
            for lo, hi in areas:
                out = out.when((kind == k) & row.between(lo, hi) & c.between(lo, hi), level[LEVELS[k][b][date - 1]])
        return out.otherwise(level["mid"]).cast("int")

    return px.withColumns({b: band(b) for b in NOISE}).withColumn("tile_id", F.concat(F.lit("px_"), F.lpad(F.col("tile").cast("string"), 6, "0")))


def pixels(spark, d):
    return _pixels(spark, d, 1)


def pixels_t2(spark, d):
    return _pixels(spark, d, 2)


def pixel_pairs(spark, d):
    """One pair per pixel tile, with dates."""
    t = pixels(spark, d).select("tile", "tile_id").distinct()
    base = F.lit("2024-01-15").cast("date")
    return t.select(
        F.col("tile_id").alias("pair_id"), "tile_id", F.concat("tile_id", F.lit("_t1")).alias("t1_tile_id"),
        F.concat("tile_id", F.lit("_t2")).alias("t2_tile_id"),
        F.date_add(base, (F.col("tile") * 17) % 365).alias("t1_date"),
        F.when(F.col("tile") % 5 != 4, F.date_add(base, (F.col("tile") * 17) % 365 + (F.col("tile") * 41) % 300)).alias("t2_date"),
    )


def observations(spark, d):
    """Dated observations of sites, with the change against the site's latest one."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("obs_id"), F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("obs_"), F.col("o_orderkey").cast("string")).alias("tile_id"), F.col("c_mktsegment").alias("sensor"),
        (F.col("o_totalprice") % 1000 / 100).alias("change_pct"), (F.col("o_orderkey") % 9 != 0).alias("has_image"),
    )


def query_log(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("query_id"), F.col("event_type").alias("query_type"),
        F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"), F.col("props").alias("filters"), "user_id", "event_id",
    )


def provenance(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("prov-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("provenance_id"),
        F.col("event_type").alias("entity_type"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("props").alias("parameters"), F.col("value").alias("confidence"), F.col("ts").alias("created_at"),
        F.lit("hashing-words").alias("embedding_model"),
    )


def current_tiles(spark, d):
    doc = table(spark, d, "documents")
    return doc.select(F.col("doc_id").cast("string").alias("tile_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"))


def manifest(spark, d):
    doc = table(spark, d, "documents")
    changed = F.col("doc_id") % 5 == 0
    return doc.where(F.col("doc_id") % 3 != 0).select(
        F.col("doc_id").cast("string").alias("tile_id"),
        F.when(changed, F.md5("text")).otherwise(F.sha2("text", 256)).alias("content_hash"),
        F.lit("hashing-words").alias("embedding_model"),
        F.when(F.col("doc_id") % 7 == 1, "hashing-words-v0").otherwise("hashing-words-v1").alias("embedding_version"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("indexed_at"),
    )


def caption_pairs(spark, d):
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").cast("string").alias("tile_id"), F.col("text").alias("caption"), F.col("lang").alias("land_cover"),
        F.when(F.col("doc_id") % 6 == 5, 0).otherwise(1).alias("label"), F.col("source").alias("scene_id"),
    )


def reviews(spark, d):
    lab = table(spark, d, "labels")
    return lab.select(
        F.col("doc_id").alias("analysis_id"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "confirmed").when(F.col("doc_id") % 4 == 0, "maybe")
        .otherwise("uncertain").alias("decision"),
    )


def caption_vectors(spark, d):
    """A second vector per tile, paired with the first: its own vector plus that of the next tile (the last keeps its own), normalised."""
    from orbitloom.functions import vector as V

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_e2"))
    mixed = F.zip_with("embedding", F.coalesce("_e2", "embedding"), lambda a, b: a.cast("double") * 0.6 + b.cast("double") * 0.8)
    return e.join(nxt, "vec_id", "left").select("vec_id", "embedding", V.unit(mixed).alias("text_embedding"))


def index_values(spark, d):
    """Index summaries from orders, spread over every land-cover rule."""
    k = F.col("o_orderkey")
    return spread(table(spark, d, "orders")).select(
        F.concat(F.lit("idx_"), k.cast("string")).alias("tile_id"), F.concat(F.lit("scene_"), (k % 4).cast("string")).alias("scene_id"),
        ((k % 121 - 40) / 100.0).alias("ndvi_mean"), ((F.floor(k / 3) % 71 - 35) / 100.0).alias("ndwi_mean"), ((k % 97) / 100.0).alias("brightness_mean"),
        ((k % 13) / 100.0).alias("brightness_std"), ((k % 17) / 100.0).alias("texture_mean"), pick(k % 4, ("winter", "pre_monsoon", "monsoon")).alias("season"),
    )


def class_files(spark, d):
    """Image files of ten scene classes from parts."""
    from orbitloom import vocab

    k = F.col("p_partkey")
    cls = pick(k % 10, [c for c, _ in vocab.CLASS_CAPTIONS])
    return table(spark, d, "part").select(
        F.concat(F.lit("/eurosat/"), cls, F.lit("/"), cls, F.lit("_"), k.cast("string"), F.lit(".jpg")).alias("path"), cls.alias("class_name")
    )


def named_tiles(spark, d):
    """Tile names that carry scene keywords, from customers."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    names = ("COASTAL_AGRICULTURE", "URBAN_INDUSTRIAL_HUB", "FOREST_WATERSHED", "SUNDARBANS_MANGROVE", "BRAHMAPUTRA", "BHADLA", "MUMBAI_PORT", "GUWAHATI", "PLATEAU")
    return c.select(F.concat(pick(k % 9, names), F.when(k % 2 == 0, "_tile_").otherwise("_"), k.cast("string")).alias("tile_id"))

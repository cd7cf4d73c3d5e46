"""Image-text pairs: land cover, captions, negatives, splits, reports.

Random choices are seeded hash orders, so a retried task picks the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.common import lookup, string_array
from .ranking import date_ordered, hash_order, hash_ranked


def land_cover_scores(df: DataFrame) -> DataFrame:
    """`land_covers`: array of (class, score), best first, ties in listing order; `mixed` when no rule fits.

    Needs ndvi_mean, ndwi_mean, brightness_mean, brightness_std, texture_mean.
    """
    v, w, b, s, t = (F.col(c) for c in ("ndvi_mean", "ndwi_mean", "brightness_mean", "brightness_std", "texture_mean"))
    cap = lambda c: F.least(F.lit(1.0), c)
    rules = (
        ("dense_vegetation", F.when(v > 0.45, cap((v - 0.45) / 0.3 + 0.5))),
        ("sparse_vegetation", F.when((v > 0.20) & (v <= 0.45), cap((v - 0.20) / 0.25 + 0.3))),
        ("water", F.when(w > 0.10, cap((w - 0.10) / 0.3 + 0.5)).when((w > -0.05) & (b < 0.20), 0.4)),
        ("built_up", F.when((v < 0.15) & (b > 0.35), cap(b * 1.2)).when((v < 0.20) & (b > 0.30) & (t > 0.08), 0.5)),
        ("bare_soil", F.when((v < 0.15) & (b < 0.35) & (b > 0.10), 0.6)),
        ("agricultural", F.when((v > 0.25) & (v < 0.55) & (t < 0.10), cap(F.lit(0.5) + (F.lit(0.55) - F.abs(v - 0.40)) / 0.3))),
        ("cloud_or_haze", F.when((b > 0.75) & (s < 0.05), 0.8)),
    )
    entry = lambda i, name, score: F.when(score.isNotNull(), F.struct(
        (-F.round(score, 6)).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("class"), F.round(score, 6).alias("score")))
    found = F.array_sort(F.array_compact(F.array(*[entry(i, n, sc) for i, (n, sc) in enumerate(rules)])))
    df = df.withColumn("_found", found)
    mixed = F.array(F.struct(F.lit("mixed").alias("class"), F.lit(0.5).alias("score")))
    listed = F.transform("_found", lambda e: F.struct(e["class"].alias("class"), e["score"].alias("score")))
    return df.withColumn("land_covers", F.when(F.size("_found") > 0, listed).otherwise(mixed)).drop("_found")


def spectral_phrase() -> Column:
    def graded(value: Column, table) -> Column:
        out = None
        for above, phrase in table:
            hit = F.lit(True) if above is None else value > above
            out = F.when(hit, phrase) if out is None else out.when(hit, phrase)
        return out

    light = F.col("brightness_mean")
    bright, dark = vocab.BRIGHT_PHRASE, vocab.DARK_PHRASE
    return F.concat(F.lit(vocab.PHRASE_START), F.concat_ws(
        vocab.PHRASE_JOIN, graded(F.col("ndvi_mean"), vocab.VEGETATION_PHRASES), graded(F.col("ndwi_mean"), vocab.WATER_PHRASES),
        F.when(light > bright[0], bright[1]).when(light < dark[0], dark[1])))


def _templates(land_cover: Column, table) -> Column:
    return lookup(land_cover, [(c, string_array(words)) for c, words in table])


def _hash(purpose: str, text: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col("tile_id"), F.lit(str(seed)), F.lit(purpose), text))


def _shuffled(words: Column, purpose: str, seed: int) -> Column:
    """A small array in seeded hash order."""
    keyed = F.transform(words, lambda t: F.struct(_hash(purpose, t, seed).alias("h"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda e: e["t"])


def captions(df: DataFrame, n: int, seed: int, season: str = "season") -> DataFrame:
    """One row per caption: sampled templates of the main class (some with the season), one mixed caption, one
    spectral caption, hash-ordered and cut to n.  At most eight short strings per tile are ever held."""
    main, second = F.col("land_covers")[0]["class"], F.get(F.col("land_covers"), F.lit(1))["class"]
    df = df.withColumn("land_cover", main).withColumns({
        "_main": _templates(main, vocab.CAPTION_TEMPLATES), "_second": _templates(second, vocab.CAPTION_TEMPLATES),
        "_season": lookup(F.col(season), vocab.SEASONS), "_phrase": spectral_phrase(),
    })
    suffix = lambda t: F.when(
        F.col("_season").isNotNull() & (_hash("season", t, seed) >= "8"), F.concat(F.lit(" "), F.col("_season"))).otherwise("")
    primary = F.transform(
        F.slice(_shuffled(F.col("_main"), "primary", seed), 1, n), lambda t: F.concat(F.lit("a satellite image showing "), t, suffix(t))
    )
    mixed = F.when(F.col("_second").isNotNull(), F.array(F.concat(
        F.lit("a satellite image showing "), _shuffled(F.col("_main"), "mix1", seed)[0], F.lit(" with "), _shuffled(F.col("_second"), "mix2", seed)[0],
    ))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_all", F.concat(primary, mixed, F.array(F.concat(F.lit("a satellite image of "), F.col("_phrase")))))
    return df.withColumn("caption", F.explode(F.slice(_shuffled(F.col("_all"), "order", seed), 1, n))).withColumn("label", F.lit(1)).drop(
        "_main", "_second", "_season", "_phrase", "_all"
    )


def absent_classes(land_covers: Column) -> Column:
    every = string_array([c for c, _ in vocab.CAPTION_TEMPLATES if c not in vocab.NOT_NEGATIVE])
    return F.array_except(every, F.transform(land_covers, lambda e: e["class"]))


def hard_negatives(df: DataFrame, n: int, seed: int) -> DataFrame:
    """One row per negative caption: a template of each of up to n absent classes."""
    df = df.withColumn("land_cover", F.col("land_covers")[0]["class"]).withColumn(
        "_class", F.explode(F.slice(_shuffled(absent_classes(F.col("land_covers")), "absent", seed), 1, n))
    ).withColumn("_words", _templates(F.col("_class"), vocab.CAPTION_TEMPLATES))
    text = F.concat(F.lit("a satellite image showing "), _shuffled(F.col("_words"), "negative", seed)[0])
    return df.withColumn("caption", text).withColumn("label", F.lit(0)).drop("_class", "_words")


def curated(df: DataFrame, per_tile: int = 3) -> DataFrame:
    """Up to three curated queries per tile for its main class."""
    df = df.withColumn("land_cover", F.col("land_covers")[0]["class"])
    words = F.coalesce(_templates(F.col("land_cover"), vocab.CURATED_QUERIES), string_array(vocab.CURATED_DEFAULT))
    return df.withColumn("_q", F.explode(F.slice(words, 1, per_tile))).withColumn(
        "caption", F.concat(F.lit("a satellite image showing "), F.col("_q"))
    ).withColumn("label", F.lit(1)).withColumn("source", F.lit("curated")).drop("_q")


PAIR_COLUMNS = ["tile_id", "scene_id", "caption", "label", "land_cover", "ndvi", "source"]


def training_pairs(summaries: DataFrame, captions_per_tile: int, negatives: int, seed: int, season: str = "season") -> DataFrame:
    """Positive, negative and curated pairs of every summarised tile."""
    df = land_cover_scores(summaries).withColumn("ndvi", F.round("ndvi_mean", 3)).withColumn("source", F.lit(None).cast("string"))
    parts = [captions(df, captions_per_tile, seed, season), hard_negatives(df, negatives, seed), curated(df)]
    return parts[0].select(PAIR_COLUMNS).unionByName(parts[1].select(PAIR_COLUMNS)).unionByName(parts[2].select(PAIR_COLUMNS))


def split_by_tile(pairs: DataFrame, share: float, seed: int, tiles: DataFrame | None = None) -> DataFrame:
    """`split`: the first max(1, share) of the tiles in hash order is val; a tile is never in both.

    Give `tiles` when the tile table is at hand: the pairs are then read once, not scanned for their ids first.
    """
    ids = (pairs if tiles is None else tiles).select("tile_id").distinct()
    return _cut(pairs, ids, ["tile_id"], share, seed, 1)


def split_by_row(pairs: DataFrame, keys: list[str], share: float, seed: int, at_least: int = 0) -> DataFrame:
    """`split` by row in hash order: max(at_least, share) rows are val; tiles may fall in both."""
    return _cut(None, pairs, keys, share, seed, at_least)


def _cut(pairs: DataFrame | None, units: DataFrame, keys: list[str], share: float, seed: int, at_least: int) -> DataFrame:
    n_val = max(at_least, int(units.count() * share))
    marked = hash_ranked(units, keys, seed, "_rank").withColumn("split", F.when(F.col("_rank") <= n_val, "val").otherwise("train")).drop("_rank")
    return marked if pairs is None else pairs.join(marked.select(*keys, "split"), keys)


def sample_per_class(files: DataFrame, n: int, seed: int, cls: str = "class_name", key: str = "path") -> DataFrame:
    """n files per class in seeded hash order; the rank filter is applied before the shuffle as well."""
    from pyspark.sql import Window

    w = Window.partitionBy(cls).orderBy(hash_order([key], seed), key)
    return files.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def class_captions(files: DataFrame, source: str = "EuroSAT_Sentinel2") -> DataFrame:
    """Every file with every caption of its class; files of unknown classes are dropped."""
    words = lookup(F.col("class_name"), [(c, string_array(t)) for c, t in vocab.CLASS_CAPTIONS])
    return files.withColumn("caption", F.explode(words)).withColumn("label", F.lit(1)).withColumn("source", F.lit(source))


def category_queries(tiles: DataFrame, name: str = "tile_id") -> DataFrame:
    """Every tile with every query of the categories its name points to (three default ones if none)."""
    matched = F.array_distinct(F.flatten(F.array_compact(F.array(*[
        F.when(F.col(name).contains(k), string_array(cats)) for k, cats in vocab.SCENE_CATEGORIES
    ]))))
    df = tiles.withColumn("_cats", matched).withColumn(
        "domain_category", F.explode(F.when(F.size("_cats") > 0, F.col("_cats")).otherwise(string_array(vocab.DEFAULT_CATEGORIES)))
    )
    words = lookup(F.col("domain_category"), [(c, string_array(t)) for c, t in vocab.QUERY_TAXONOMY])
    scene = F.when(F.col(name).contains("_tile_"), F.split_part(F.col(name), F.lit("_tile_"), F.lit(1))).otherwise(F.col(name))
    return df.withColumn("caption", F.explode(words)).withColumn("scene_id", scene).withColumn("label", F.lit(1)).drop("_cats")


def words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def class_distribution(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split", F.coalesce("land_cover", F.lit("unknown")).alias("land_cover")).agg(F.count("*").alias("pairs"))


def caption_lengths(pairs: DataFrame) -> DataFrame:
    n = words(F.col("caption"))
    return pairs.groupBy("split").agg(
        F.count("*").alias("total"), F.round(F.avg(n), 1).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max")
    )


def captions_by_tile(pairs: DataFrame, chunk: int = 500) -> DataFrame:
    """(tile_id, part, captions): a tile's captions in parts of `chunk`, the last one shorter.

    Captions are numbered within their tile by hash prefix and caption, so a tile with most of the captions is
    numbered in many small sorts.
    """
    numbered = date_ordered(pairs.withColumn("_prefix", F.substring(F.md5("caption"), 1, 3)), ["tile_id"], "_prefix", [F.col("caption")])
    part = F.floor((F.col("position") - 1) / F.lit(chunk)).cast("int")
    return numbered.groupBy("tile_id", part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "caption"))), lambda x: x["caption"]).alias("captions")
    )


def distinct_captions(pairs: DataFrame) -> DataFrame:
    return pairs.select("caption").distinct()


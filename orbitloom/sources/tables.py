"""Readers and writers: files, manifests, keyed Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import naming as N


ROWS_PER_TASK = 100_000


def spread(scan: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Use on a plain file scan ahead of heavy per-row work: the rows are dealt out so that a task has at most about
    `rows_per_task` and every core has one.  The partitions of a scan don't tell that: they are cut by bytes, and a file of a few
    large row groups leaves most of them empty.  The count is read from the files' footers."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, -(-scan.count() // rows_per_task)))


def scene_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """GeoTIFF files of a folder: path, length, modificationTime, content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}")
        .option("recursiveFileLookup", str(recursive).lower()).load(folder)
    )


def class_folder(spark: SparkSession, folder: str, glob: str = "*.jpg") -> DataFrame:
    """Image files below class folders: path, class_name (the folder), tile_id = class_stem."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .load(folder).select("path", "length")
    )
    cls = N.parent_folder(F.col("path"))
    return files.select("path", "length", cls.alias("class_name"), F.concat_ws("_", cls, N.stem(F.col("path"))).alias("tile_id"))


def read_scene_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCENE_MANIFEST).option("header", True).csv(path)


def replace_in_manifest(existing: DataFrame, record: DataFrame) -> DataFrame:
    """Manifest rows without the record's keys, then the record."""
    return existing.join(record.select("scene_id"), "scene_id", "left_anti").unionByName(record)


def write_scene_manifest(df: DataFrame, path: str) -> None:
    df.select(*schemas.names(schemas.SCENE_MANIFEST)).write.mode("overwrite").option("header", True).csv(path)


def read_relevance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RELEVANCE).option("header", True).csv(path)


def relevance_sets(judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgments once per (query, tile), and set sizes per query.

    Sets stay in long form: a query judged on most of the archive is never one array.
    """
    once = judgments.groupBy("query_id", "tile_id").agg(F.max("relevant").alias("relevant"), F.max("query").alias("query"))
    sizes = once.groupBy("query_id").agg(
        F.max("query").alias("query"), F.count_if(F.col("relevant") == 1).alias("relevant_count"),
        F.count_if(F.col("relevant") != 1).alias("non_relevant_count"),
    )
    return once, sizes


def read_pairs(spark: SparkSession, path: str, positive_only: bool = True, one_document: bool = True) -> DataFrame:
    """Image-text pairs of manifest files; a missing label counts as 1.

    `one_document` reads files that hold a single JSON document each (one task per
    file); line-delimited manifests are splittable.
    """
    pairs = (
        spark.read.schema(schemas.PAIR_MANIFEST).option("multiLine", one_document).json(path)
        .select(F.explode("pairs").alias("p")).select("p.*")
    )
    return pairs.where(F.coalesce("label", F.lit(1)) == 1) if positive_only else pairs


def split_summary(pairs: DataFrame) -> DataFrame:
    """Header counts per split: total, positive, negative, unique tiles."""
    return pairs.groupBy("split").agg(
        F.count("*").alias("total_pairs"), F.count_if(F.col("label") == 1).alias("positive_pairs"),
        F.count_if(F.col("label") == 0).alias("negative_pairs"), F.countDistinct("tile_id").alias("unique_tiles"),
    )


def write_pairs(pairs: DataFrame, folder: str) -> None:
    """Pairs as JSON partitioned by split, header counts beside them."""
    pairs.write.mode("overwrite").partitionBy("split").json(f"{folder}/pairs")
    split_summary(pairs).write.mode("overwrite").json(f"{folder}/metadata")


def read_caption_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Nested caption corpus: one row per image (filename, split, sentences)."""
    return (
        spark.read.schema(schemas.CAPTION_CORPUS).option("multiLine", True).json(path)
        .select(F.posexplode("images").alias("image_no", "i")).select("image_no", "i.*")
    )


def flatten_captions(images: DataFrame, max_samples: int | None = None, per_image: int = 3, scene: str = "RSICD") -> DataFrame:
    """Up to three non-empty sentences per image; split `train` stays, anything else is `val`, a missing one `train`.

    `max_samples` is the corpus-sampling option of the reader: the first images in file order.
    """
    if max_samples is not None:
        images = images.where(F.col("image_no") < max_samples)
    kept = F.slice(F.filter("sentences", lambda s: s["raw"].isNotNull() & (s["raw"] != "")), 1, per_image)
    return images.select(
        "filename", F.when(F.coalesce("split", F.lit("train")) == "train", "train").otherwise("val").alias("split"),
        F.explode(kept).alias("s"),
    ).select(
        F.col("filename").alias("image_path"), F.col("s.raw").alias("caption"), N.stem(F.col("filename")).alias("tile_id"),
        F.lit(scene).alias("scene_id"), F.lit(1).alias("label"), "split",
    )


def write_report(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def resolve_paths(tiles: DataFrame, files: DataFrame, root: str = "data/public") -> DataFrame:
    """The first existing file of each tile among its recorded path, the path below the root, and the usual
    names in the tile folder; null when none exists.  `files` lists existing paths (path)."""
    p = F.col("file_path")
    places = F.array(
        p, F.concat(F.lit(root + "/"), p), F.concat(F.lit(root + "/tiles/"), N.file_name(p)),
        F.concat(F.lit(root + "/tiles/"), "tile_id", F.lit(".png")), F.concat(F.lit(root + "/tiles/"), "tile_id", F.lit(".jpg")),
    )
    tried = tiles.select("tile_id", F.posexplode(places).alias("_order", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("tile_id").agg(F.min_by("path", "_order").alias("found_path"))
    return tiles.join(found, "tile_id", "left")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("tile_id", "embedding").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tile_id STRING, embedding ARRAY<FLOAT>").parquet(path)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the predicate is pushed to the scan."""
    return df.where(F.col(key) == value)

"""Hash-based incremental indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .catalog import upsert
from .embedding import Encoder, encode_texts


def content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(content), 256))


def classify(current: DataFrame, manifest: DataFrame, model: str, version: str) -> DataFrame:
    """NEW, MODIFIED or UNCHANGED per current tile (tile_id, content_hash); rows without content are ignored.

    Only manifest rows of this model count; a changed hash or model version is MODIFIED.
    """
    known = manifest.where(F.col("embedding_model") == model).select(
        "tile_id", F.col("content_hash").alias("_hash"), F.col("embedding_version").alias("_version")
    )
    same = (F.col("_hash") == F.col("content_hash")) & (F.col("_version") == version)
    return (
        current.where(F.col("content_hash").isNotNull()).join(known, "tile_id", "left")
        .withColumn("change", F.when(F.col("_hash").isNull(), "NEW").when(same, "UNCHANGED").otherwise("MODIFIED"))
        .drop("_hash", "_version")
    )


def not_indexed(tiles: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Tiles without a vector of this model."""
    return tiles.join(embeddings.where(F.col("model_name") == model).select("tile_id"), "tile_id", "left_anti")


def index_changes(current: DataFrame, manifest: DataFrame, vectors: DataFrame, encoder: Encoder, stamp,
                  content: str = "content") -> tuple[DataFrame, DataFrame]:
    """New manifest and vector tables after encoding NEW and MODIFIED tiles; both are true upserts."""
    todo = classify(current, manifest, encoder.name, encoder.version).where(F.col("change") != "UNCHANGED")
    rows = encode_texts(todo.select("tile_id", "content_hash", F.col(content).alias("_content")), "_content", encoder)
    stamped = rows.select(
        "tile_id", F.lit(encoder.name).alias("model_name"), F.lit(encoder.version).alias("model_version"),
        F.lit(encoder.dim).alias("vector_dim"), F.lit(stamp).cast("timestamp").alias("created_at"), "embedding",
    )
    entries = todo.select(
        "tile_id", "content_hash", F.lit(encoder.name).alias("embedding_model"),
        F.lit(encoder.version).alias("embedding_version"), F.lit(stamp).cast("timestamp").alias("indexed_at"),
    )
    return (
        upsert(manifest, entries, ["tile_id", "embedding_model"], ["indexed_at", "content_hash"]),
        upsert(vectors, stamped, ["tile_id", "model_name"], ["created_at"]),
    )

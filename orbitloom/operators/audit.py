"""Query log, provenance and review records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions.common import key_id
from .ranking import exact_percentiles


def query_log_rows(searches: DataFrame) -> DataFrame:
    """Query-log rows from (query_key, query_type, query_text, query_tile_id, bbox_*, date_from, date_to, sensor,
    result_count, latency_ms, created_at); ids derive from the key, so a retried write repeats the same id."""
    filters = F.to_json(F.struct("bbox", "date_from", "date_to", "sensor"), {"ignoreNullFields": "false"})
    return searches.select(
        key_id("q-", F.col("query_key")).alias("query_id"), "query_type", "query_text", "query_tile_id",
        filters.alias("filters"), "result_count", "latency_ms", "created_at",
    )


def provenance_rows(events: DataFrame) -> DataFrame:
    """Provenance rows; `parameters` and `result_summary` are structs or null."""
    as_json = lambda c: F.when(F.col(c).isNotNull(), F.to_json(c, {"ignoreNullFields": "false"}))
    return events.select(
        key_id("prov-", F.col("entity_type"), F.col("entity_id"), F.col("created_at")).alias("provenance_id"),
        "entity_type", "entity_id", "query_text", "query_tile_id", "embedding_model", "embedding_version",
        F.lit(vocab.PROCESSING_VERSION).alias("processing_version"), as_json("parameters").alias("parameters"),
        as_json("result_summary").alias("result_summary"), "confidence", "created_at",
    )


def tolerant_json(df: DataFrame, column: str, key: str, out: str) -> DataFrame:
    """One JSON field as text; malformed JSON keeps the original text."""
    parsed = F.try_parse_json(F.col(column))
    return df.withColumn(out, F.when(parsed.isNull(), F.col(column)).otherwise(F.try_variant_get(parsed, f"$.{key}", "string")))


def recent(records: DataFrame, limit: int = 50, tie: str = "provenance_id") -> DataFrame:
    """The newest `limit` records (planned as a distributed top-k)."""
    return records.orderBy(F.col("created_at").desc(), tie).limit(limit)


def by_entity(records: DataFrame, entity_type: str, entity_id: str | None = None, tie: str = "provenance_id") -> DataFrame:
    df = records.where(F.col("entity_type") == entity_type)
    if entity_id is not None:
        df = df.where(F.col("entity_id") == entity_id)
    return df.orderBy(F.col("created_at").desc(), tie)


def latency_by(log: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, p50 and p95 latency per key, exact and interpolated."""
    return exact_percentiles(log, keys, "latency_ms", [0.5, 0.95])


def latency_rollup(log: DataFrame) -> DataFrame:
    """Count and mean latency per (type, day), per type, and overall."""
    return (
        log.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).rollup("query_type", "day")
        .agg(F.count("*").alias("queries"), F.avg("latency_ms").alias("mean_latency_ms"))
    )


def review_tallies(reviews: DataFrame) -> DataFrame:
    """Reviews per analysis and decision, one column per decision."""
    return reviews.groupBy("analysis_id").agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in vocab.REVIEW_DECISIONS]
    )


def provenance_jsonld(records: DataFrame) -> DataFrame:
    """Each record as a PROV-O JSON-LD activity."""
    doc = F.struct(
        F.lit("http://www.w3.org/ns/prov#").alias("@context"), F.lit("Activity").alias("@type"),
        F.col("provenance_id").alias("@id"), F.col("entity_type").alias("type"), F.col("entity_id").alias("generated"),
        F.col("embedding_model").alias("used"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("endedAtTime"),
    )
    return records.select("provenance_id", F.to_json(doc).alias("jsonld"))

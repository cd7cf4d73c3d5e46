"""Explicit schemas (DDL); CSV, JSON and streaming sources are never inferred."""

from __future__ import annotations

SCENES = (
    "scene_id STRING, file_path STRING, sensor STRING, acquisition_date DATE, crs STRING, "
    "bounds_minx DOUBLE, bounds_miny DOUBLE, bounds_maxx DOUBLE, bounds_maxy DOUBLE, "
    "width INT, height INT, band_count INT, file_size_bytes BIGINT, ingested_at TIMESTAMP, processing_version STRING"
)
TILES = (
    "tile_id STRING, scene_id STRING, file_path STRING, x_index INT, y_index INT, crs STRING, "
    "bounds_minx DOUBLE, bounds_miny DOUBLE, bounds_maxx DOUBLE, bounds_maxy DOUBLE, "
    "center_lat DOUBLE, center_lon DOUBLE, width INT, height INT, band_count INT, created_at TIMESTAMP"
)
VECTORS = (
    "tile_id STRING, model_name STRING, model_version STRING, vector_dim INT, created_at TIMESTAMP, embedding ARRAY<FLOAT>"
)
INDEX_MANIFEST = (
    "tile_id STRING, content_hash STRING, embedding_model STRING, embedding_version STRING, indexed_at TIMESTAMP"
)
CHANGE_ANALYSES = (
    "analysis_id STRING, tile_id STRING, t1_tile_id STRING, t2_tile_id STRING, change_type STRING, confidence DOUBLE, "
    "structural_confidence DOUBLE, seasonal_confound DOUBLE, cloud_contamination DOUBLE, registration_quality DOUBLE, "
    "persistence_score DOUBLE, earliest_supported STRING, change_mask_path STRING, change_pixels BIGINT, "
    "total_pixels BIGINT, status STRING, created_at TIMESTAMP, completed_at TIMESTAMP"
)
ANALYST_REVIEWS = (
    "review_id STRING, analysis_id STRING, tile_id STRING, decision STRING, notes STRING, analyst STRING, created_at TIMESTAMP"
)
PROVENANCE = (
    "provenance_id STRING, entity_type STRING, entity_id STRING, query_text STRING, query_tile_id STRING, "
    "embedding_model STRING, embedding_version STRING, processing_version STRING, parameters STRING, "
    "result_summary STRING, confidence DOUBLE, created_at TIMESTAMP"
)
QUERY_LOG = (
    "query_id STRING, query_type STRING, query_text STRING, query_tile_id STRING, filters STRING, "
    "result_count INT, latency_ms DOUBLE, created_at TIMESTAMP"
)
SCENE_MANIFEST = (
    "scene_id STRING, product_id STRING, source STRING, sensor STRING, acquisition_datetime STRING, crs STRING, "
    "bbox STRING, width INT, height INT, band_count INT, file_path STRING, file_size_bytes BIGINT, "
    "source_reference STRING, license STRING, downloaded_at STRING, processing_version STRING"
)
RELEVANCE = "query_id STRING, query STRING, tile_id STRING, relevant INT"
PAIR = (
    "image_path STRING, caption STRING, tile_id STRING, scene_id STRING, label INT, land_cover STRING, ndvi DOUBLE, "
    "source STRING, class_name STRING, domain_category STRING"
)
PAIR_MANIFEST = f"metadata MAP<STRING, STRING>, pairs ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in PAIR.split(', '))}>>"
CAPTION_CORPUS = "images ARRAY<STRUCT<filename: STRING, split: STRING, sentences: ARRAY<STRUCT<raw: STRING>>>>"


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [field.split(" ")[0] for field in ddl.split(", ")]

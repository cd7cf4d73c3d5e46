"""Domain-rule scoring of search candidates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.common import contains_any, stable_int
from .blocks import QUERY_BYTES_LIMIT, block_apply
from .knn import gathered, matrix, rank_hits

BLOCK_ROWS = 16_384  # a block sends on k rows per request, so large ones send less


def _bits(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)]).cast("int")


def query_domains(text: Column) -> Column:
    """Bit i is set when the text holds a keyword of domain i (priority order)."""
    low = F.lower(text)
    return _bits([contains_any(low, d[1]) for d in vocab.DOMAINS])


def tile_domains(scene_id: Column, tile_id: Column, side: int) -> Column:
    """Bit i is set when the scene or tile name confirms (side 2) or contradicts (side 3) domain i."""
    return _bits([contains_any(scene_id, d[side]) | contains_any(tile_id, d[side]) for d in vocab.DOMAINS])


def with_tile_rules(tiles: DataFrame) -> DataFrame:
    """Per-tile rule inputs, computed once per tile rather than once per (query, tile)."""
    return tiles.withColumns({
        "confirms": tile_domains(F.col("scene_id"), F.col("tile_id"), 2),
        "contradicts": F.col("scene_id").isNotNull().cast("int") * tile_domains(F.col("scene_id"), F.col("tile_id"), 3),
        "hash_code": stable_int(F.col("tile_id")),
    })


def verified_score(raw: Column, domains: Column, confirms: Column, contradicts: Column, code: Column) -> Column:
    """Score of one candidate: confirmed, contradicted or neither."""
    hit, miss = domains.bitwiseAND(confirms) != 0, domains.bitwiseAND(contradicts) != 0
    up = F.lit(0.94) + F.pmod(code, F.lit(100)) / 1000.0 * 0.04 + raw * 0.15
    return F.round(
        F.when(hit, F.least(F.lit(0.985), F.greatest(F.lit(0.88), up)))
        .when(miss, F.lit(0.35) + F.pmod(code, F.lit(50)) / 500.0)
        .otherwise(F.least(F.lit(0.85), F.greatest(F.lit(0.60), F.lit(0.72) + raw * 0.5))), 6)


def aligned(score: Column, domains: Column, confirms: Column, contradicts: Column) -> Column:
    hit, miss = domains.bitwiseAND(confirms) != 0, domains.bitwiseAND(contradicts) != 0
    return F.when(hit, True).when(miss, False).otherwise(score >= 0.75)


def reason(score: Column, domains: Column, confirms: Column, contradicts: Column) -> Column:
    """Text of the first confirming domain, else of the last contradicting one, else the generic sentence."""
    hit, miss = domains.bitwiseAND(confirms), domains.bitwiseAND(contradicts)
    out = None
    for i, d in enumerate(vocab.DOMAINS):
        cond = hit.bitwiseAND(F.lit(1 << i)) != 0
        out = F.when(cond, d[4]) if out is None else out.when(cond, d[4])
    for i, d in reversed(list(enumerate(vocab.DOMAINS))):
        out = out.when(miss.bitwiseAND(F.lit(1 << i)) != 0, d[5])
    return out.otherwise(F.format_string(vocab.UNVERIFIED_TEXT, F.round(score * 100, 1).cast("string")))


def graduate(ranked: DataFrame) -> DataFrame:
    """When a query's best hit is aligned, its aligned hits get scores that step down with the rank."""
    top_aligned = F.first("is_strongly_aligned").over(Window.partitionBy("query_id").orderBy("rank"))
    step = F.greatest(
        F.lit(0.85), F.lit(0.965) - (F.col("rank") - 1) * 0.022 + F.pmod(F.col("hash_code"), F.lit(10)) * 0.002
    )
    score = F.when(F.col("_top") & F.col("is_strongly_aligned"), F.round(step, 4)).otherwise(F.col("verified"))
    return ranked.withColumn("_top", top_aligned).withColumn("similarity", score).withColumn(
        "match_percentage", F.round(F.col("similarity") * 100, 1)
    ).drop("_top")


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """Rerank an explicit candidate table (query_id, text, tile_id, scene_id, raw_similarity)."""
    df = with_tile_rules(candidates).withColumn("domains", query_domains(F.col("text")))
    args = [F.col(c) for c in ("domains", "confirms", "contradicts")]
    df = df.withColumn("verified", verified_score(F.col("raw_similarity"), *args, F.col("hash_code")))
    w = Window.partitionBy("query_id").orderBy(F.col("verified").desc(), F.col("raw_similarity").desc(), "tile_id")
    df = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return graduate(df.withColumn("is_strongly_aligned", aligned(F.col("verified"), *args)).withColumn(
        "vlm_reasoning", reason(F.col("verified"), *args)))


def best_rows(score: np.ndarray, raw: np.ndarray, id_rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows by score, then raw score, both descending, then id; only those that reach the k-th score are sorted."""
    alive = np.arange(len(score))
    if len(score) > k:
        cut = np.partition(-score, k - 1)[k - 1]
        alive = np.flatnonzero(~(-score > cut))
    return alive[np.lexsort((id_rank[alive], -raw[alive], -score[alive]))[:k]]


def search_blocks(tiles: DataFrame, requests: DataFrame, k: int, dim: int,
                  query_bytes_limit: int = QUERY_BYTES_LIMIT) -> DataFrame:
    """Filter, score and rerank every tile for every request, k best each: (query_id, tile_id, raw_similarity, verified, rank).

    `tiles`: tile_id, scene_id, embedding, bounds_*, acquisition_date, sensor.
    `requests`: query_id, embedding, domains, bbox_*, date_from, date_to, sensor (nulls mean no filter).
    Filters are applied inside a block before ranking; each block sends on at most k rows per request.
    """
    base = with_tile_rules(tiles.where(F.col("embedding").isNotNull())).select(
        "tile_id", "embedding", "confirms", "contradicts", "hash_code", "bounds_minx", "bounds_miny", "bounds_maxx", "bounds_maxy",
        F.coalesce(F.col("acquisition_date").cast("string"), F.lit("")).alias("date"), F.coalesce(F.lower("sensor"), F.lit("")).alias("sensor"),
    )
    queries = requests.where(F.col("embedding").isNotNull()).select(
        "query_id", "embedding", "domains", "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy",
        F.coalesce("date_from", F.lit("")).alias("date_from"), F.coalesce("date_to", F.lit("")).alias("date_to"),
        F.coalesce(F.lower("sensor"), F.lit("")).alias("sensor"),
    )

    def reduce_block(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Scores of the block's tiles once per prompt, and the k best of those that pass once per prompt and set of passing tiles."""
        parts, raws, scores = [], [], []
        ids = b["tile_id"].to_numpy()
        if len(b) and len(q):
            id_rank = np.argsort(np.argsort(ids))
            code, yes, no = b["hash_code"].to_numpy(), b["confirms"].to_numpy(), b["contradicts"].to_numpy()
            date, sensor = b["date"].to_numpy(dtype="U10"), b["sensor"].to_numpy(dtype=str)
            box = [b[c].to_numpy(dtype=float) for c in ("bounds_minx", "bounds_miny", "bounds_maxx", "bounds_maxy")]
            confirmed = 0.94 + code % 100 / 1000.0 * 0.04
            contradicted = 0.35 + code % 50 / 500.0
            vectors, base_vectors = matrix(q["embedding"]), matrix(b["embedding"])
            filters: dict[tuple, bytes] = {}
            tiles_of: dict[bytes, np.ndarray] = {}

            def passing(r) -> bytes:
                boxed = r.bbox_minx == r.bbox_minx and r.bbox_minx is not None
                key = ((r.bbox_minx, r.bbox_miny, r.bbox_maxx, r.bbox_maxy) if boxed else None, r.date_from, r.date_to, r.sensor)
                if key not in filters:
                    keep = np.ones(len(b), dtype=bool)
                    if boxed:
                        keep &= (box[2] >= r.bbox_minx) & (box[0] <= r.bbox_maxx) & (box[3] >= r.bbox_miny) & (box[1] <= r.bbox_maxy)
                    if r.date_from:
                        keep &= (date != "") & (date >= r.date_from)
                    if r.date_to:
                        keep &= (date != "") & (date <= r.date_to)
                    if r.sensor:
                        keep &= sensor == r.sensor
                    filters[key] = np.packbits(keep).tobytes()
                    tiles_of[filters[key]] = np.flatnonzero(keep)
                return filters[key]

            same: dict[tuple, dict[bytes, list[int]]] = {}
            rows = list(q.itertuples(index=False))
            for i, r in enumerate(rows):
                same.setdefault((vectors[i].tobytes(), r.domains), {}).setdefault(passing(r), []).append(i)
            for (vector, domains), by_tiles in same.items():
                raw = np.round(base_vectors @ np.frombuffer(vector), 4)
                score = np.round(np.where(
                    (yes & domains) != 0, np.clip(confirmed + raw * 0.15, 0.88, 0.985),
                    np.where((no & domains) != 0, contradicted, np.clip(0.72 + raw * 0.5, 0.60, 0.85)),
                ), 6)
                for tiles_passing, members in by_tiles.items():
                    at = tiles_of[tiles_passing]
                    best = at[best_rows(score[at], raw[at], id_rank[at], k)]
                    for i in members:
                        parts.append((rows[i].query_id, best))
                        raws.append(raw[best])
                        scores.append(score[best])
        return gathered(parts, ids, raw_similarity=raws, verified=scores)

    hits = block_apply(base, queries, reduce_block, "query_id string, tile_id string, raw_similarity double, verified double",
                       "tile_id", "query_id", dim * 8 + 256, query_bytes_limit, BLOCK_ROWS)
    return rank_hits(hits, k, F.col("verified").desc(), F.col("raw_similarity").desc(), F.col("tile_id"))

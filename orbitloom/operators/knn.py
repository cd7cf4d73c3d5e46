"""Exact and approximate nearest neighbours over a vector table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vector as V
from .blocks import QUERY_BYTES_LIMIT, block_apply
from .cellscan import best_in_cells, look_bits

SCAN_ROWS = 64  # queries whose scores are held at a time
HIT_SCHEMA = "query_id string, tile_id string, score double"
# cells of the approximate index and how many of them a query looks into: recall over 0.97 on the given tables (README)
CELLS, PROBES = 16, 12


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def top_rows(primary: np.ndarray, tie_keys: list[np.ndarray], k: int) -> np.ndarray:
    """Indices of the k best entries by primary descending, then the tie keys ascending; -inf never qualifies."""
    alive = np.flatnonzero(np.isfinite(primary))
    if len(alive) > k:
        cut = np.partition(primary[alive], len(alive) - k)[len(alive) - k]
        alive = alive[primary[alive] >= cut]
    order = np.lexsort([key[alive] for key in reversed(tie_keys)] + [-primary[alive]])
    return alive[order[:k]]


def gathered(parts: list[tuple], ids: np.ndarray, **columns: list[np.ndarray]) -> pd.DataFrame:
    """One frame from per-query winners: parts are (query id, base indices)."""
    if not parts:
        return pd.DataFrame({"query_id": [], "tile_id": [], **{c: [] for c in columns}})
    at = np.concatenate([i for _, i in parts])
    return pd.DataFrame({
        "query_id": np.repeat(np.array([q for q, _ in parts], dtype=object), [len(i) for _, i in parts]),
        "tile_id": ids[at], **{c: np.concatenate(v) for c, v in columns.items()},
    })


def _block_top(b: pd.DataFrame, q: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """k best base rows of one block for each query of one block."""
    parts, won = [], []
    ids = b["tile_id"].to_numpy()
    if len(b) and len(q):
        id_rank = np.argsort(np.argsort(ids))
        rows, asked, qids = matrix(b["embedding"]).T, matrix(q["embedding"]), q["query_id"].to_numpy()
        for at in range(0, len(q), SCAN_ROWS):  # the product of two whole blocks is never held
            scores = asked[at:at + SCAN_ROWS] @ rows
            rounded = np.round(scores, 6)
            for i, qid in enumerate(qids[at:at + SCAN_ROWS]):
                s = np.where(ids == qid, -np.inf, rounded[i]) if exclude_self else rounded[i]
                best = top_rows(s, [id_rank], k)
                parts.append((qid, best))
                won.append(scores[i][best])
    return gathered(parts, ids, score=won)


def rank_hits(hits: DataFrame, k: int, *order) -> DataFrame:
    """Merge block winners: rank per query and keep k.  The rank filter is applied before the shuffle too."""
    order = order or (F.round("score", 6).desc(), F.col("tile_id"))
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(base: DataFrame, queries: DataFrame, k: int, dim: int, exclude_self: bool = False,
            query_bytes_limit: int = QUERY_BYTES_LIMIT) -> DataFrame:
    """Top-k tiles by inner product for every query: (query_id, tile_id, score, rank).

    `base` is (tile_id, embedding), `queries` is (query_id, embedding); filters
    belong on `base` before this call.  k above the table size returns all rows.
    Scores that agree to 6 decimals rank by tile id.
    """
    def reduce_block(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _block_top(b, q, k, exclude_self)

    base = base.where(F.col("embedding").isNotNull()).select("tile_id", "embedding")
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    hits = block_apply(base, queries, reduce_block, HIT_SCHEMA, "tile_id", "query_id", dim * 8 + 64, query_bytes_limit)
    return rank_hits(hits, k)


def nearest_one(base: DataFrame, vector: list[float], k: int) -> DataFrame:
    """Top-k for one literal query vector; stays on the JVM and plans as TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return (
        base.select("tile_id", F.round(V.dot(F.col("embedding"), q), 6).alias("score"))
        .orderBy(F.col("score").desc(), "tile_id").limit(k)
    )


def similar_to(base: DataFrame, tile_ids: DataFrame, k: int, dim: int) -> DataFrame:
    """Similarity by stored id: fetch each tile's own vector, search, leave the tile itself out."""
    queries = base.join(tile_ids.select("tile_id").distinct(), "tile_id", "left_semi").select(
        F.col("tile_id").alias("query_id"), "embedding"
    )
    return nearest(base, queries, k, dim, exclude_self=True)


def with_tile_metadata(hits: DataFrame, tiles: DataFrame, scenes: DataFrame, kind: str = "text") -> DataFrame:
    """Hits joined to tile and scene facts, with calibrated scores; hits without a tile row are dropped."""
    facts = tiles.drop("embedding").join(scenes.select("scene_id", "sensor", "acquisition_date"), "scene_id")
    conf = V.text_confidence(F.col("score")) if kind == "text" else V.image_confidence(F.col("score"))
    return (
        hits.join(facts, "tile_id")
        .withColumn("similarity", conf)
        .withColumn("raw_similarity", F.round("score", 4))
        .withColumn("match_percentage", V.match_percentage(F.col("similarity")))
        .withColumn("image_url", F.concat(F.lit("/api/archive/tiles/"), "tile_id", F.lit("/image")))
    )


def match_rank(images: DataFrame, texts: DataFrame, dim: int, query_bytes_limit: int = QUERY_BYTES_LIMIT) -> DataFrame:
    """Rank of each text's own image among all images: (query_id, rank).

    Each block only counts the images that beat the matching one, so what is
    shuffled is one number per (text, block).
    """
    own = texts.join(images.select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("_own")), "query_id")
    queries = own.select("query_id", "embedding", F.round(V.dot(F.col("embedding"), F.col("_own")), 6).alias("own"))

    def reduce_block(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({"query_id": [], "beaten_by": []})
        scores = np.round(matrix(q["embedding"]) @ matrix(b["embedding"]).T, 6)
        own_score = q["own"].to_numpy()[:, None]
        ids, qid = b["tile_id"].to_numpy(), q["query_id"].to_numpy()
        ahead = (scores > own_score).sum(axis=1)
        # equal scores are rare: only those compare ids
        qi, bi = np.nonzero(scores == own_score)
        np.add.at(ahead, qi, (ids[bi] < qid[qi]).astype(ahead.dtype))
        return pd.DataFrame({"query_id": q["query_id"], "beaten_by": ahead})

    parts = block_apply(images.select("tile_id", "embedding"), queries, reduce_block, "query_id string, beaten_by long",
                        "tile_id", "query_id", dim * 8 + 72, query_bytes_limit)
    return parts.groupBy("query_id").agg((F.sum("beaten_by") + 1).alias("rank"))


def nearest_by_cells(base: DataFrame, queries: DataFrame, k: int, dim: int, cells: int = CELLS, probes: int = PROBES,
                     iterations: int = 5, seed: int = 42) -> DataFrame:
    """Approximate top-k: every tile is assigned to its nearest k-means cell and a query looks into its nearest cells.

    Cells are cut into blocks of bounded size, which meet chunks of queries without a copy per block of the other (`cellscan`), so a cell
    that attracts much of the archive is spread over many tasks.  Recall against `nearest` is measured in the tests.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    train = base.select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=cells, maxIter=iterations, seed=seed).fit(train)
    centers = np.asarray(model.clusterCenters())

    def nearest_cells(pdf: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        m = matrix(pdf["embedding"])
        return m, np.argsort(0.5 * (centers ** 2).sum(axis=1)[None, :] - m @ centers.T, axis=1)[:, :n]

    def number_type(df: DataFrame) -> type:
        return np.float32 if dict(df.dtypes)["embedding"] == "array<float>" else np.float64

    row_type, query_type, total = number_type(base), number_type(queries), len(centers)

    def in_cell(batches):
        for pdf in batches:
            if len(pdf):
                m, cell = nearest_cells(pdf, 1)
                yield pd.DataFrame({"tile_id": pdf["tile_id"], "cell": cell[:, 0].astype(np.int32), "data": [x.tobytes() for x in m.astype(row_type)]})

    def looking(batches):
        for pdf in batches:
            if len(pdf):
                m, look = nearest_cells(pdf, min(probes, total))
                yield pd.DataFrame({"query_id": pdf["query_id"], "asked": [x.tobytes() for x in m.astype(query_type)], "looks": look_bits(look, total)})

    rows = base.select("tile_id", "embedding").mapInPandas(in_cell, "tile_id string, cell int, data binary")
    asked = queries.select("query_id", "embedding").mapInPandas(looking, "query_id string, asked binary, looks binary")
    # one row per cell: at most `cells` rows, so it may pass through the driver and be broadcast
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    width = centers.shape[1]

    def vectors(_cell: int, data: bytes) -> np.ndarray:
        return np.frombuffer(data, row_type).reshape(-1, width)

    row_bytes = width * np.dtype(row_type).itemsize + 32
    hits = best_in_cells(rows, sizes, asked, queries.count(), total, k, query_type, vectors, row_bytes)
    return rank_hits(hits, k)

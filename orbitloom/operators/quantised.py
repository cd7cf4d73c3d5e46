"""Compressed approximate search: product quantisation, and an exact rerank of a short list.

A row is coded as its cell and one byte for each `PART_DIMS` dimensions of what is left after the cell's center is taken off: the
number of the nearest of up to 256 code words.  A query's score of a row is its product with the center plus the code words
of the row, so the scan reads `dim / PART_DIMS` bytes a row instead of the vector.  The best `SHORTLIST`
rows per query are fetched as full vectors and ranked by their true scores.

Centers and code words are fitted on at most `SAMPLE_ROWS` rows, those with the smallest hashes of their ids (the documented
sample); every row is coded.  The number of cells grows with the root of the row count up to `MAX_CELLS`.  A query looks into the
share `PROBE_SHARE` of the cells; cells are cut into pieces and their queries into chunks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .cellscan import best_in_cells, best_listed, look_bits
from .knn import HIT_SCHEMA, matrix, rank_hits
from .pruned import bounded_sample, centers_of, nearest_center

SAMPLE_ROWS, MAX_CELLS, PART_DIMS, WORDS = 8_192, 1_024, 4, 256
SHORTLIST, PROBE_SHARE = 80, 0.75
PIECE_ROWS, CHUNK_ROWS, SCAN_ROWS = 65_536, 2_048, 64


@dataclass
class Codebook:
    centers: np.ndarray  # cells x dim
    words: list[np.ndarray]  # code words of each part

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, at:at + PART_DIMS] for at in range(0, vectors.shape[1], PART_DIMS)]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, one byte per part) of every vector."""
        cell = nearest_center(vectors, self.centers)[0]
        left = self.parts(vectors - self.centers[cell])
        return cell, np.stack([nearest_center(x, w)[0] for x, w in zip(left, self.words, strict=True)], axis=1).astype(np.uint8)


@dataclass
class CodedIndex:
    base: DataFrame  # tile_id, embedding
    codes: DataFrame  # tile_id, block (the cell), code
    book: Codebook | None  # none for an empty base
    sizes: dict[int, int]


def build(base: DataFrame, sample_rows: int = SAMPLE_ROWS) -> CodedIndex:
    """Codes of all rows of `base` (tile_id, embedding)."""
    base = base.where(F.col("embedding").isNotNull()).select("tile_id", "embedding")
    sample = bounded_sample(base, sample_rows)
    if not len(sample):
        return CodedIndex(base, base.select("tile_id", F.lit(0).alias("block"), F.lit(b"").alias("code")), None, {})
    cells = max(1, min(MAX_CELLS, round(base.count() ** 0.5 / 4), len(sample) // 16))
    centers = centers_of(sample, cells)
    book = Codebook(centers, [])
    left = sample - centers[nearest_center(sample, centers)[0]]
    book.words = [centers_of(np.ascontiguousarray(x), min(WORDS, len(sample))) for x in book.parts(left)]

    def coded(batches):
        for pdf in batches:
            if len(pdf):
                cell, code = book.encode(matrix(pdf["embedding"]))
                yield pd.DataFrame({"tile_id": pdf["tile_id"], "block": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    codes = materialize(base.mapInPandas(coded, "tile_id string, block int, code binary"), "codes")
    sizes = {r["block"]: r["n"] for r in codes.groupBy("block").agg(F.count("*").alias("n")).collect()}  # one row per cell
    return CodedIndex(base, codes, book, sizes)


def probed(batches, centers: np.ndarray, held: np.ndarray, probes: int):
    """The queries, repeated for each of the `probes` cells of `held` that they look into."""
    for whole in batches:
        for at in range(0, len(whole), SCAN_ROWS):  # with their vectors, so few at a time
            pdf = whole.iloc[at:at + SCAN_ROWS].reset_index(drop=True)
            best = np.argsort(-(matrix(pdf["embedding"]) @ centers[held].T), axis=1, kind="stable")[:, :probes]
            yield pdf.loc[pdf.index.repeat(probes)].assign(block=held[best.ravel()].astype(np.int32))


def looking(batches, centers: np.ndarray, held: np.ndarray, probes: int, number: type):
    """The queries once, with one bit for each cell they look into."""
    for some in probed(batches, centers, held, probes):
        pdf = some.iloc[::probes]
        yield pd.DataFrame({"query_id": pdf["query_id"], "asked": [x.tobytes() for x in matrix(pdf["embedding"]).astype(number)],
                            "looks": look_bits(some["block"].to_numpy().reshape(-1, probes), len(centers))})


def _number_type(df: DataFrame) -> type:
    return np.float32 if dict(df.dtypes)["embedding"] == "array<float>" else np.float64


def shortlist(index: CodedIndex, queries: DataFrame, size: int, probe_share: float = PROBE_SHARE) -> DataFrame:
    """The `size` rows with the largest coded scores for every query: (query_id, tile_id, score, rank)."""
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    book = index.book
    if book is None:
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA + ", rank int")
    held = np.array(sorted(index.sizes))
    probes = max(1, int(np.ceil(probe_share * len(held))))
    number, cells, parts = _number_type(queries), len(book.centers), len(book.words)

    def decoded(cell: int, data: bytes) -> np.ndarray:
        code = np.frombuffer(data, np.uint8).reshape(-1, parts)
        return book.centers[cell] + np.concatenate([w[code[:, j]] for j, w in enumerate(book.words)], axis=1)

    asked = queries.mapInPandas(lambda batches: looking(batches, book.centers, held, probes, number), "query_id string, asked binary, looks binary")
    rows = index.codes.select("tile_id", F.col("block").alias("cell"), F.col("code").alias("data"))
    hits = best_in_cells(rows, index.sizes, asked, queries.count(), cells, size, number, decoded, parts + 32, PIECE_ROWS, CHUNK_ROWS)
    return rank_hits(hits, size)


def nearest(index: CodedIndex, queries: DataFrame, k: int, size: int = SHORTLIST, probe_share: float = PROBE_SHARE,
            listed: DataFrame | None = None) -> DataFrame:
    """About the k rows with the largest inner products: (query_id, tile_id, score, rank); scores are exact.

    `listed` is the `shortlist` of these queries, if it is at hand.
    """
    if listed is None:
        listed = shortlist(index, queries, max(size, k), probe_share)
    if index.book is None:
        return listed
    queries = queries.where(F.col("embedding").isNotNull())
    row_type, query_type, width = _number_type(index.base), _number_type(queries), index.book.centers.shape[1]

    def bytes_of(number: type, key: str, name: str):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({key: pdf[key], name: [x.tobytes() for x in matrix(pdf["embedding"]).astype(number)]})
        return run

    rows = index.base.mapInPandas(bytes_of(row_type, "tile_id", "data"), "tile_id string, data binary")
    lists = listed.groupBy("query_id").agg(F.collect_list("tile_id").alias("listed"))
    asked = queries.select("query_id", "embedding").mapInPandas(bytes_of(query_type, "query_id", "asked"), "query_id string, asked binary")
    hits = best_listed(rows, sum(index.sizes.values()), asked.join(lists, "query_id"), queries.count(), k, query_type,
                       lambda data: np.frombuffer(data, row_type).reshape(-1, width), width * np.dtype(row_type).itemsize + 32)
    return rank_hits(hits, k)

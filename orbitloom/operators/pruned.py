"""Exact vector search that skips what a bound rules out.

The base is cut into blocks: cells around centers, and within a cell rings by the distance from its center.  Centers and
ring borders come from a bounded sample; they only decide how well the bounds cut.  Every base row is in one block, and
a block's true distances, norms and size are taken from all of its rows.

For a query q and a block with center c, radii lo and hi and largest norm m, any vector x in it has
    q.x <= q.c + |q| hi     and     q.x <= (|q|^2 + m^2 - g^2) / 2,  g = max(0, |q - c| - hi, lo - |q - c|),
and q.x >= q.c - |q| hi.  A query first looks into the blocks with the largest bounds until they hold k rows; the k-th
score found there rules out all blocks with smaller bounds, and the rest are looked into.  So the rows are those of the full
search.  Only the block table (at most `MAX_BLOCKS` rows) passes through the driver; queries never do.

What moves goes by *units* of neighbouring blocks (`PIECE_ROWS` rows or so): a query is sent once to each unit that holds a block
it asks for, with one bit per block, so vectors that don't cluster are sent to a few units and not to every block.  A task
holds one unit (or a piece of it) and one chunk of its queries (`CHUNK_ROWS`), and scores `SCAN_ROWS` queries at a
time in single precision; only what could be among the best by the error of that is scored again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .knn import HIT_SCHEMA, matrix, rank_hits
from .ranking import one_row

SAMPLE_ROWS, MAX_CELLS, MAX_BLOCKS = 4_096, 256, 4_096
BLOCK_ROWS, PIECE_ROWS, CHUNK_ROWS = 1_024, 65_536, 16_384
SMALL_PIECE, SMALL_CHUNK = 4_096, 2_048  # of small tables, which are cut into eight pieces and sixteen chunks
BOUND_ROWS = 256  # queries whose bounds are computed together
SCAN_ROWS = 64  # queries that a task scores together
SLACK = 1e-6  # scores are compared to six decimals


def centers_of(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 42) -> np.ndarray:
    """Centers by k-means on a bounded sample, started far apart."""
    rng = np.random.default_rng(seed)
    first = [int(rng.integers(len(sample)))]
    gap = ((sample - sample[first[0]]) ** 2).sum(axis=1)
    while len(first) < cells and gap.max() > 0:
        first.append(int(rng.choice(len(sample), p=gap / gap.sum())))
        gap = np.minimum(gap, ((sample - sample[first[-1]]) ** 2).sum(axis=1))
    centers = sample[first].copy()
    for _ in range(rounds):
        own = nearest_center(sample, centers)[0]
        size = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        centers[size > 0] = total[size > 0] / size[size > 0][:, None]
    return centers


def nearest_center(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center and the distance from it."""
    half = 0.5 * (centers ** 2).sum(axis=1)
    own = np.argmax(vectors @ centers.T - half, axis=1) if len(vectors) else np.zeros(0, np.int64)
    return own, np.sqrt(((vectors - centers[own]) ** 2).sum(axis=1))


def bounded_sample(base: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The vectors of the `rows` rows with the smallest hashes of their ids: the same rows on every run."""
    return matrix(base.select("embedding", F.xxhash64("tile_id").alias("h")).orderBy("h").limit(rows).toPandas()["embedding"])


@dataclass
class Blocks:
    centers: np.ndarray
    cell: np.ndarray  # of each block; the arrays below, too
    number: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norm: np.ndarray
    size: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores in every block, one row per query."""
        q_norm = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        dot = queries @ self.centers.T
        far = np.sqrt(np.maximum(0.0, q_norm ** 2 + (self.centers ** 2).sum(axis=1)[None, :] - 2 * dot))
        dot, far = dot[:, self.cell], far[:, self.cell]
        gap = np.maximum(0.0, np.maximum(far - self.hi, self.lo - far))
        reach = q_norm * self.hi
        return np.minimum(dot + reach, (q_norm ** 2 + self.norm ** 2 - gap ** 2) / 2) + SLACK, dot - reach - SLACK


@dataclass
class BlockIndex:
    rows: DataFrame  # tile_id, embedding, block
    blocks: Blocks  # goes to the tasks


def build(base: DataFrame, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> BlockIndex:
    """The blocks of `base` (tile_id, embedding); about `block_rows` rows each, but never more than MAX_BLOCKS blocks."""
    base = base.where(F.col("embedding").isNotNull()).select("tile_id", "embedding")
    sample = bounded_sample(base, sample_rows)
    none = np.zeros(0)
    if not len(sample):
        return BlockIndex(base.withColumn("block", F.lit(0)), Blocks(np.zeros((1, 1)), none.astype(int), none.astype(int), none, none, none, none.astype(int)))
    total = base.count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // block_rows)))
    centers = centers_of(sample, max(1, min(MAX_CELLS, round(blocks ** 0.5) * 2, len(sample) // 8)))
    own, distance = nearest_center(sample, centers)
    # a cell has as many rings as its share of the sample asks for
    borders = []
    for c in range(len(centers)):
        inside = np.sort(distance[own == c])
        rings = max(1, round(blocks * len(inside) / len(sample)))
        borders.append(np.quantile(inside, np.arange(1, rings) / rings) if rings > 1 else np.zeros(0))
    first = np.concatenate(([0], np.cumsum([len(b) + 1 for b in borders])))

    def placed(batches):
        for pdf in batches:
            m = matrix(pdf["embedding"])
            if not len(pdf):
                continue
            cell, gone = nearest_center(m, centers)
            ring = np.zeros(len(pdf), np.int64)
            for c in np.unique(cell):
                ring[cell == c] = np.searchsorted(borders[c], gone[cell == c])
            yield pdf.assign(block=(first[cell] + ring).astype(np.int32), gone=gone, norm=np.sqrt((m ** 2).sum(axis=1)))

    kind = dict(base.dtypes)["embedding"]
    rows = materialize(base.mapInPandas(placed, f"tile_id string, embedding {kind}, block int, gone double, norm double"), "blocks")
    facts = rows.groupBy("block").agg(
        F.min("gone").alias("lo"), F.max("gone").alias("hi"), F.max("norm").alias("norm"), F.count("*").alias("size")).toPandas().sort_values("block")
    number = facts["block"].to_numpy()
    return BlockIndex(rows.select("tile_id", "embedding", "block"), Blocks(
        centers, np.searchsorted(first, number, "right") - 1, number,
        facts["lo"].to_numpy() - 1e-9, facts["hi"].to_numpy() + 1e-9, facts["norm"].to_numpy() + 1e-9, facts["size"].to_numpy()))


def _sizes(blocks: Blocks) -> tuple[int, int]:
    """Rows of a unit, and of a chunk of queries."""
    total = int(blocks.size.sum())
    return min(PIECE_ROWS, max(SMALL_PIECE, total // 8)), min(CHUNK_ROWS, max(SMALL_CHUNK, total // 16))


def units_of(blocks: Blocks) -> np.ndarray:
    """The unit of every block: neighbours in the order of the table, cells beside cells."""
    before = np.cumsum(blocks.size) - blocks.size
    return np.unique(before // _sizes(blocks)[0], return_inverse=True)[1]


def _asked(blocks: Blocks, queries: DataFrame, choose: Callable, extra: str = "") -> DataFrame:
    """One row (query_id, embedding, extra..., block, wanted, n) per query and unit (column block) of which `choose(pdf, upper, lower)`
    (a boolean matrix) asks for n blocks, one bit for each block of the unit."""
    kind = dict(queries.dtypes)["embedding"]
    schema = f"query_id string, embedding {kind}{extra}, block int, wanted binary, n int"
    if not len(blocks.number):
        return queries.sparkSession.createDataFrame([], schema)
    unit = units_of(blocks)
    first = np.flatnonzero(np.diff(unit, prepend=-1))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), BOUND_ROWS):
                pdf = whole.iloc[at:at + BOUND_ROWS].reset_index(drop=True)
                chosen = choose(pdf, *blocks.bounds(matrix(pdf["embedding"])))
                n = np.add.reduceat(chosen, first, axis=1, dtype=np.int32)
                for u, cols in enumerate(np.split(chosen, first[1:], axis=1)):
                    q = np.flatnonzero(n[:, u])
                    bits = np.packbits(cols[q], axis=1)
                    yield pdf.iloc[q].assign(block=np.int32(u), wanted=[x.tobytes() for x in bits], n=n[q, u])

    return queries.mapInPandas(run, schema)


def in_grid(rows: DataFrame, sizes: dict[int, int], asked: DataFrame, reduce_block: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
            piece_rows: int, chunk_rows: int) -> DataFrame:
    """`reduce_block(rows, queries)` for every block and the queries that ask for it, in pieces and chunks of bounded size.
    `sizes`: the rows of each block."""
    spark = rows.sparkSession
    asked = materialize(asked, "asked")
    # at most one row per block
    wanted = {r["block"]: r["n"] for r in asked.groupBy("block").agg(F.count("*").alias("n")).collect()}
    shape = [(int(b), -(-int(n) // piece_rows), -(-wanted[b] // chunk_rows)) for b, n in sizes.items() if b in wanted]
    if not shape:
        return spark.createDataFrame([], schema)
    shapes = F.broadcast(spark.createDataFrame(shape, "block int, pieces int, chunks int"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(shapes, "block").withColumn("piece", part("tile_id", "pieces")).withColumn("chunk", every("chunks")).drop("pieces", "chunks")
    right = asked.join(shapes, "block").withColumn("chunk", part("query_id", "chunks")).withColumn("piece", every("pieces")).drop("pieces", "chunks")
    grid = ["block", "piece", "chunk"]

    def cell(_key, b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return reduce_block(b.reset_index(drop=True), q.reset_index(drop=True))

    # cells are heavy in work but light in bytes: a fixed partition count keeps them from being merged into few tasks
    tasks = min(sum(p * c for _, p, c in shape), 32 * spark.sparkContext.defaultParallelism)
    dealt = lambda df: df.repartition(tasks, *grid).groupBy(*grid)
    return dealt(left).cogroup(dealt(right)).applyInPandas(cell, schema)


def _scored(index: BlockIndex, asked: DataFrame, reduce_unit: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    blocks = index.blocks
    unit = units_of(blocks)
    spark = index.rows.sparkSession
    of = spark.createDataFrame(list(zip(blocks.number.tolist(), unit.tolist(), strict=True)), "part int, block int")
    rows = index.rows.withColumnRenamed("block", "part").join(F.broadcast(of), "part")
    sizes = dict(enumerate(np.bincount(unit, blocks.size).astype(int).tolist()))
    piece, chunk = _sizes(blocks)
    return in_grid(rows, sizes, asked, reduce_unit, schema, 2 * piece, chunk)


def _strips(blocks: Blocks, unit: np.ndarray, b: pd.DataFrame, q: pd.DataFrame):
    """For some queries of a unit at a time: (places in q, places in b, their scores in single precision, the greatest error of these,
    their vectors).  Rows of blocks that a query does not ask for have -inf; `b` is in the order of blocks."""
    u = int(q["block"].iloc[0])
    number = blocks.number[unit == u]
    part = np.searchsorted(number, b["part"].to_numpy())
    rows, asked = matrix(b["embedding"]), matrix(q["embedding"])
    longest = float(np.sqrt((rows ** 2).sum(axis=1).max()))
    length = np.sqrt((asked ** 2).sum(axis=1))
    # beyond this, single precision could overflow
    exact = max(longest, float(length.max())) > 1e15
    narrow, unit_error = (rows, 2.0 ** -52) if exact else (rows.astype(np.float32), 2.0 ** -23)
    wanted = np.unpackbits(np.frombuffer(b"".join(q["wanted"]), np.uint8).reshape(len(q), -1), axis=1)[:, :len(number)].astype(bool)
    # queries that ask for the same blocks stand together
    near = np.lexsort((np.argmax(asked @ blocks.centers.T, axis=1), np.argmax(wanted, axis=1)))
    for at in range(0, len(q), SCAN_ROWS):
        qi = near[at:at + SCAN_ROWS]
        some = wanted[qi]
        held = some.any(axis=0)[part]
        bi = np.flatnonzero(held)
        if not len(bi):
            continue
        scores = asked[qi].astype(narrow.dtype) @ (narrow if held.all() else narrow[bi]).T
        edge = np.searchsorted(part[bi], np.arange(len(number) + 1))
        for i, j in zip(*np.nonzero(~some), strict=True):
            scores[i, edge[j]:edge[j + 1]] = -np.inf
        error = (rows.shape[1] + 8) * unit_error * length[qi] * longest + 1e-30
        yield qi, bi, scores, error, asked[qi], rows


def _unit_top(blocks: Blocks, unit: np.ndarray, b: pd.DataFrame, q: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k best rows of a unit for each of its queries; those under a query's `least` score may be left out."""
    none = pd.DataFrame({"query_id": [], "tile_id": [], "score": []})
    if not len(b) or not len(q):
        return none
    b = b.sort_values("part", kind="stable", ignore_index=True)
    ids, qid, least = b["tile_id"].to_numpy(), q["query_id"].to_numpy(), q["least"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    id_rank = np.empty(len(ids), np.int64)
    id_rank[by_id] = np.arange(len(ids))
    if exclude_self:
        sorted_ids = ids[by_id]
        lo, hi = np.searchsorted(sorted_ids, qid, "left"), np.searchsorted(sorted_ids, qid, "right")
    out = []
    for qi, bi, scores, error, asked, rows in _strips(blocks, unit, b, q):
        if exclude_self:
            for i in np.flatnonzero(hi[qi] > lo[qi]):
                own = by_id[lo[qi[i]]:hi[qi[i]]]
                own = own[np.isin(own, bi)]
                scores[i, np.searchsorted(bi, own)] = -np.inf
        # half a unit of the sixth decimal on either side
        slack = (error + SLACK).astype(scores.dtype)
        cut = np.maximum(least[qi] - slack, np.finfo(scores.dtype).min).astype(scores.dtype)
        of, at = np.nonzero(scores >= cut[:, None])
        got = scores[of, at]
        keep = np.ones(len(of), bool)
        edge = np.searchsorted(of, np.arange(len(qi) + 1))
        for i in np.flatnonzero(np.diff(edge) > k):
            mine = got[edge[i]:edge[i + 1]]
            keep[edge[i]:edge[i + 1]] = mine >= np.partition(mine, len(mine) - k)[len(mine) - k] - 2 * slack[i]
        of, at = of[keep], bi[at[keep]]
        score = np.einsum("ij,ij->i", asked[of], rows[at])
        order = np.lexsort((id_rank[at], -np.round(score, 6), of))
        of, at, score = of[order], at[order], score[order]
        edge = np.searchsorted(of, np.arange(len(qi) + 1))
        top = np.arange(len(of)) - edge[of] < k
        top &= np.isfinite(score)
        out.append(pd.DataFrame({"query_id": qid[qi[of[top]]], "tile_id": ids[at[top]], "score": score[top]}))
    return pd.concat(out, ignore_index=True) if out else none


def nearest(base: DataFrame | BlockIndex, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The k rows of `base` with the largest inner product for every query: (query_id, tile_id, score, rank).

    Scores that agree to 6 decimals rank by tile id; k above the table size returns all rows.
    """
    return _search(base if isinstance(base, BlockIndex) else build(base), queries, k, exclude_self)[0]


def _looked_first(upper: np.ndarray, size: np.ndarray, need: int) -> list[np.ndarray]:
    """For every query the blocks with the largest bounds that hold `need` rows together."""
    left = upper.copy()
    out, held = [[] for _ in upper], np.zeros(len(upper), np.int64)
    rows = np.arange(len(upper))
    while len(rows):
        best = np.argmax(left[rows], axis=1)
        for i, j in zip(rows.tolist(), best.tolist(), strict=True):
            out[i].append(j)
        held[rows] += size[best]
        left[rows, best] = -np.inf
        rows = rows[(held[rows] < need) & (np.array([len(out[i]) for i in rows]) < upper.shape[1])]
    return [np.array(x, np.int32) for x in out]


def _search(index: BlockIndex, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    need = k + 1 if exclude_self else k
    blocks = index.blocks
    unit = units_of(blocks)
    kind = dict(queries.dtypes)["embedding"]

    def choosing(batches):
        for whole in batches:
            for at in range(0, len(whole), BOUND_ROWS):
                pdf = whole.iloc[at:at + BOUND_ROWS]
                yield pdf.assign(first=_looked_first(blocks.bounds(matrix(pdf["embedding"]))[0], blocks.size, need))

    def firsts(pdf: pd.DataFrame, like: np.ndarray) -> np.ndarray:
        out = np.zeros(like.shape, bool)
        for i, x in enumerate(pdf["first"]):
            out[i, x] = True
        return out

    def top(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _unit_top(blocks, unit, b, q, k, exclude_self)

    # written once, so that both looks agree on what was seen first
    if len(blocks.number):
        queries = materialize(queries.mapInPandas(choosing, f"query_id string, embedding {kind}, first array<int>"), "queries")
    else:
        queries = queries.withColumn("first", F.array().cast("array<int>"))
    extra = ", first array<int>, least double"
    no_limit = queries.withColumn("least", F.lit(float("-inf")))
    near = _asked(blocks, no_limit, lambda pdf, upper, lower: firsts(pdf, upper), extra).drop("first")
    first = materialize(rank_hits(_scored(index, near, top, HIT_SCHEMA), k), "first")
    known = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # a query with fewer than k rows so far has no threshold
    limited = queries.join(known, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = _asked(
        blocks, limited, lambda pdf, upper, lower: (upper >= pdf["least"].to_numpy()[:, None] - SLACK) & ~firsts(pdf, upper), extra).drop("first")
    hits = first.drop("rank").unionByName(_scored(index, rest, top, HIT_SCHEMA))
    return rank_hits(hits, k), near, rest


def scored_share(base: DataFrame | BlockIndex, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """One row (queries, blocks, pairs, scored): how many of the pairs of query and block an exact search looks into."""
    index = base if isinstance(base, BlockIndex) else build(base)
    _, near, rest = _search(index, queries, k, exclude_self)
    looked = near.select("n").unionByName(rest.select("n"))
    asked = queries.where(F.col("embedding").isNotNull()).agg(F.count("*").alias("queries"))
    n = len(index.blocks.number)
    return one_row(asked, looked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))).select(
        "queries", F.lit(n).alias("blocks"), (F.col("queries") * n).alias("pairs"), "scored")


def match_rank(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Rank of each text's own image among all images: (query_id, rank).

    A block whose lower bound is above the own score counts with all its rows, one whose upper bound is below it with
    none; only the others are scored, and each sends one number per text.
    """
    from ..functions import vector as V

    index = build(images.select("tile_id", "embedding"))
    blocks = index.blocks
    own = images.select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("own_vector"))
    queries = materialize(
        texts.select("query_id", "embedding").join(own, "query_id")
        .select("query_id", "embedding", F.round(V.dot(F.col("embedding"), F.col("own_vector")), 6).alias("own")), "own")
    bound = lambda pdf: pdf["own"].to_numpy()[:, None]
    near = _asked(blocks, queries, lambda pdf, upper, lower: (upper >= bound(pdf) - SLACK) & (lower <= bound(pdf) + SLACK), ", own double")

    def ahead(batches):
        for whole in batches:
            for at in range(0, len(whole), BOUND_ROWS):
                pdf = whole.iloc[at:at + BOUND_ROWS]
                _, lower = blocks.bounds(matrix(pdf["embedding"]))
                yield pd.DataFrame({"query_id": pdf["query_id"], "beaten_by": (lower > bound(pdf) + SLACK) @ blocks.size})

    unit = units_of(blocks)

    def reduce_unit(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({"query_id": [], "beaten_by": []})
        b = b.sort_values("part", kind="stable", ignore_index=True)
        ids, qid, own = b["tile_id"].to_numpy(), q["query_id"].to_numpy(), q["own"].to_numpy()
        better = np.zeros(len(q), np.int64)
        for qi, bi, scores, error, asked, rows in _strips(blocks, unit, b, q):
            slack = error + 2 * SLACK
            over = scores > (own[qi] + slack).astype(scores.dtype)[:, None]
            better[qi] += np.count_nonzero(over, axis=1)
            # what the error leaves open is scored again
            of, at = np.nonzero((scores >= (own[qi] - slack).astype(scores.dtype)[:, None]) & ~over)
            at, mine = bi[at], own[qi[of]]
            score = np.round(np.einsum("ij,ij->i", asked[of], rows[at]), 6)
            ahead = score > mine
            same = np.flatnonzero(score == mine)
            ahead[same] = ids[at[same]] < qid[qi[of[same]]]
            np.add.at(better, qi, np.bincount(of[ahead], minlength=len(qi)))
        return pd.DataFrame({"query_id": qid, "beaten_by": better})

    schema = "query_id string, beaten_by long"
    parts = queries.mapInPandas(ahead, schema).unionByName(_scored(index, near, reduce_unit, schema))
    return parts.groupBy("query_id").agg((F.sum("beaten_by") + 1).alias("rank"))


def share_of(row) -> float:
    """The scored share of all pairs of a `scored_share` row."""
    return row["scored"] / row["pairs"] if row["pairs"] else 0.0

"""The best rows of the cells that a query looks into, without a copy of either side per block of the other.

Rows are packed into blocks (one row of a table holds up to `BLOCK_ROWS` rows of one cell) and queries into chunks.  Blocks are dealt
out to *parts* (`PART_BYTES` or so each) and chunks to *lanes*, of which there are `LANES` at most whatever the size of the
tables.  A task joins the chunks of a lane with the blocks of a part: it holds one part and one chunk at a time, goes over the blocks
with the k best rows so far of every query, and sends them on once per part.  So a block is written once per lane, and a chunk
and its hits once per part.  `best_listed` does so for rows that are listed for a query, not for cells.

Scores are computed in single precision; only what could be among the k best by the error of that is scored again in double precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_ROWS, PART_BYTES = 4_096, 64 * 1024 * 1024
CHUNK_ROWS, SMALL_CHUNK = 8_192, 256  # queries of a chunk, and of a lane at least
LISTED_BLOCK_ROWS, LISTED_CHUNK_ROWS = 16_384, 4_096  # lists are longer than the vectors
LANES, LISTED_LANES = 16, 8  # a listed row is little work
STRIP_ROWS = 128  # queries that a task scores together
DENSE = 16  # with more candidates than this part of a strip, the strip is scored again as a whole
SENT_ROWS = 16_384
SLACK = 1e-6  # scores are compared to six decimals
HITS = pa.schema([("query_id", pa.string()), ("tile_id", pa.string()), ("score", pa.float64())])
BLOCKS = pa.schema([("part", pa.int32()), ("cell", pa.int32()), ("ids", pa.list_(pa.string())), ("data", pa.binary())])
CHUNKS = pa.schema([("lane", pa.int32()), ("chunk", pa.string()), ("qids", pa.list_(pa.string())), ("asked", pa.binary()), ("looks", pa.binary())])
LISTED = pa.schema([("lane", pa.int32()), ("chunk", pa.string()), ("qids", pa.list_(pa.string())), ("asked", pa.binary()), ("sizes", pa.list_(pa.int32())), ("listed", pa.list_(pa.string()))])


def look_bits(cells: np.ndarray, total: int) -> list[bytes]:
    """One bit for each of `total` cells, for every row of `cells`."""
    looks = np.zeros((len(cells), total), bool)
    np.put_along_axis(looks, cells, True, axis=1)
    return [x.tobytes() for x in np.packbits(looks, axis=1)]


def _packs(batches: Iterator[pa.RecordBatch], rows: int, by: str | None) -> Iterator[pa.Table]:
    """The rows in packs of up to `rows`; with `by`, of equal values that stand together."""
    held, n, last = [], 0, None
    for batch in batches:
        size = batch.num_rows
        kind = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(size, np.int32)
        edges = np.append(np.flatnonzero(np.diff(kind)) + 1, size)
        at = 0
        for edge in edges if size else ():
            while at < edge:
                if n and (n == rows or kind[at] != last):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                step = min(int(edge) - at, rows - n)
                held.append(batch.slice(at, step))
                n, last, at = n + step, kind[at], at + step
    if n:
        yield pa.Table.from_batches(held)


def _one(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)


def _bytes(table: pa.Table, name: str) -> bytes:
    return b"".join(table.column(name).to_pylist())


class Chunk:
    """Queries with the k best rows so far, by score to six decimals and then by id."""

    def __init__(self, ids: pa.Array, asked: np.ndarray, looks: np.ndarray | None, k: int):
        n = len(ids)
        self.qids, self.asked, self.looks, self.k = ids, asked.astype(np.float64, copy=False), looks, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.narrow = asked.astype(np.float32, copy=False)
            self.length = np.sqrt(np.einsum("ij,ij->i", self.asked, self.asked))
        self.longest = float(np.nan_to_num(self.length, nan=np.inf).max(initial=0.0))
        self.rounded, self.score = np.full((n, k), -np.inf), np.full((n, k), -np.inf)
        self.ids = np.full((n, k), None, dtype=object)
        self.waiting, self.waits = [], 0  # rows that are not yet among the best or left out

    def meet(self, cell: int, rows: np.ndarray, ids: pa.Array) -> None:
        """Take in the rows of a block; `ids` ascend."""
        look = np.flatnonzero(self.looks[:, cell])
        if not len(look) or not len(rows):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
            longest = float(np.nan_to_num(length, nan=np.inf).max())
            # beyond this, single precision could overflow
            exact = not max(longest, self.longest) <= 1e15
            narrow = rows.astype(np.float64 if exact else np.float32, copy=False)
            unit_error = 2.0 ** -52 if exact else 2.0 ** -23
            for at in range(0, len(look), STRIP_ROWS):
                qi = look[at:at + STRIP_ROWS]
                scores = (self.asked if exact else self.narrow)[qi] @ narrow.T
                if exact:
                    scores[~np.isfinite(scores)] = -np.inf
                # half a unit of the sixth decimal on either side
                slack = np.nan_to_num((rows.shape[1] + 8) * unit_error * self.length[qi] * longest + 1e-30 + SLACK, nan=np.inf).astype(scores.dtype)
                self._strip(qi, scores, slack, rows, ids)
        if 2 * self.waits >= self.rounded.size:
            self.merge()

    def _strip(self, qi: np.ndarray, scores: np.ndarray, slack: np.ndarray, rows: np.ndarray, ids: pa.Array) -> None:
        k, width = self.k, scores.shape[1]
        cut = np.maximum(self.rounded[qi, -1] - slack, np.finfo(scores.dtype).min).astype(scores.dtype)
        hit = scores >= cut[:, None]
        # beyond k, the block's own k-th score counts as well
        for i in np.flatnonzero(np.count_nonzero(hit, axis=1) > k):
            hit[i] &= scores[i] >= np.partition(scores[i], width - k)[width - k] - 2 * slack[i]
        of, at = np.nonzero(hit)
        if not len(of):
            return
        if len(of) * DENSE > hit.size:
            score = (self.asked[qi] @ rows.astype(np.float64, copy=False).T)[of, at]
        else:
            score = np.einsum("ij,ij->i", self.asked[qi[of]], rows[at].astype(np.float64, copy=False))
        self.take(qi[of], at, score, ids)

    def take(self, q: np.ndarray, at: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Take in scores of queries and rows of a block."""
        rounded = np.round(score, 6)
        keep = np.flatnonzero(np.isfinite(score) & (rounded >= self.rounded[q, -1]))
        keep = keep[np.lexsort((at[keep], -rounded[keep], q[keep]))]
        keep = keep[np.arange(len(keep)) - np.searchsorted(q[keep], q[keep]) < self.k]
        if len(keep):
            self.waiting.append((q[keep], rounded[keep], score[keep], np.array(ids.take(pa.array(at[keep])).to_pylist(), dtype=object)))
            self.waits += len(keep)

    def merge(self) -> None:
        if not self.waiting:
            return
        k = self.k
        of, rounded, score, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.waits = [], 0
        q, group = np.unique(of, return_inverse=True)
        of = np.concatenate((np.repeat(np.arange(len(q)), k), group))
        rounded, score = np.concatenate((self.rounded[q].ravel(), rounded)), np.concatenate((self.score[q].ravel(), score))
        ids = np.concatenate((self.ids[q].ravel(), ids))
        order = np.lexsort((-rounded, of))
        same = (of[order][1:] == of[order][:-1]) & (rounded[order][1:] == rounded[order][:-1]) & np.isfinite(rounded[order][1:])
        if same.any():  # only equal scores compare ids; no id comes first
            tied = order[np.append(same, False) | np.append(False, same)]
            by_id = np.zeros(len(of), np.int64)
            by_id[tied] = np.unique(np.array(["" if x is None else "_" + x for x in ids[tied]], dtype=object), return_inverse=True)[1]
            order = np.lexsort((by_id, -rounded, of))
        first = np.searchsorted(of[order], np.arange(len(q)))
        best = order[(first[:, None] + np.arange(k)).ravel()]  # every query has k entries at least
        self.rounded[q], self.score[q], self.ids[q] = (x[best].reshape(-1, k) for x in (rounded, score, ids))

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        of, at = np.nonzero(np.isfinite(self.rounded))
        for i in range(0, len(of), SENT_ROWS):
            q, r = of[i:i + SENT_ROWS], at[i:i + SENT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [self.qids.take(pa.array(q)).cast(pa.string()), pa.array(self.ids[q, r], pa.string()), pa.array(self.score[q, r])], schema=HITS)


def _blocks(rows: DataFrame, sizes: dict[int, int], block_rows: int, parts: int) -> DataFrame:
    """`rows` (tile_id, cell, data) in blocks of up to `block_rows` rows of a cell, dealt out to parts."""
    spark = rows.sparkSession
    pieces = {int(c): -(-n // block_rows) for c, n in sizes.items()}
    if len(pieces) == 1:  # which may be a constant, and constants are not joined by key
        shaped = rows.withColumn("pieces", F.lit(*pieces.values()))
    else:  # one row per cell
        shaped = rows.join(F.broadcast(spark.createDataFrame(list(pieces.items()), "cell int, pieces int")), "cell")

    def packed(batches):
        first = TaskContext.get().partitionId()
        for n, t in enumerate(_packs(batches, block_rows, "cell")):
            yield _one(BLOCKS, (first + n) % parts, t.column("cell")[0].as_py(), t.column("tile_id").to_pylist(), _bytes(t, "data"))

    dealt = shaped.withColumn("piece", F.pmod(F.xxhash64("tile_id"), F.col("pieces"))).repartition(
        max(1, min(sum(pieces.values()), 4 * spark.sparkContext.defaultParallelism)), "cell", "piece").sortWithinPartitions("cell", "tile_id")
    return dealt.select("cell", "tile_id", "data").mapInArrow(packed, "part int, cell int, ids array<string>, data binary")


def _parts(rows: int, row_bytes: int) -> int:
    return max(1, -(-rows * row_bytes // PART_BYTES))


def _lanes(queries: DataFrame, asking: int, most: int, chunk_rows: int) -> tuple[DataFrame, int, int]:
    """The queries dealt out evenly, with the number of lanes and of rows of a chunk; a partition's lane goes by its number."""
    lanes = max(1, min(most, 2 * queries.sparkSession.sparkContext.defaultParallelism, -(-asking // SMALL_CHUNK)))
    rounds = max(1, -(-asking // (lanes * chunk_rows)))
    return queries.repartition(lanes * rounds), lanes, chunk_rows


def _keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a shuffle of n partitions sends to one partition each, as far as they are found quickly."""
    tried = spark.range(64 * n).select(F.col("id").cast("int").alias("key")).withColumn("to", F.pmod(F.hash("key"), F.lit(n)))
    found = {r["to"]: r["key"] for r in tried.groupBy("to").agg(F.min("key").alias("key")).collect()}
    return [found.get(i, 64 * n + i) for i in range(n)]


def _pairs(chunks: DataFrame, lanes: int, blocks: DataFrame, parts: int) -> DataFrame:
    """Every chunk with every block; the blocks of a part come one after another for a chunk."""
    tasks = lanes * parts
    keys = F.array(*[F.lit(k) for k in _keys(chunks.sparkSession, tasks)])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = (keys[F.col("lane") * parts + F.col("part")]).alias("key")
    left = chunks.withColumn("part", every(parts)).select(key, *[c for c in chunks.columns if c != "lane"])
    right = blocks.withColumn("lane", every(lanes)).select(key, *[c for c in blocks.columns if c != "part"])
    return left.repartition(tasks, "key").join(right.repartition(tasks, "key").hint("merge"), "key").drop("key")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            yield {name: c[i] for name, c in column.items()}


def _asked(row: dict, query_type: type) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a chunk, which outlive the batch."""
    ids = pa.array(row["qids"].as_py(), pa.string())
    return ids, np.frombuffer(row["asked"].as_py(), query_type).reshape(len(ids), -1)


HIT_TYPES = "query_id string, tile_id string, score double"


def best_in_cells(rows: DataFrame, sizes: dict[int, int], queries: DataFrame, asking: int, cells: int, k: int, query_type: type,
                  vectors: Callable[[int, bytes], np.ndarray], row_bytes: int, block_rows: int | None = None, most_queries: int | None = None) -> DataFrame:
    """The k rows with the largest products with every query, of the cells it looks into, once for each part of the rows:
    (query_id, tile_id, score).

    `rows` is (tile_id, cell, data), and `vectors(cell, data)` makes vectors of the joined data of rows of a cell; `sizes` has the rows
    of each cell.  `queries` is (query_id, asked, looks): the bytes of the vector's numbers of `query_type`, and the bits of the cells;
    `asking` is their number.  `row_bytes` is about the bytes of a row.  A block has at most `block_rows`, a chunk `most_queries`.
    """
    if not sizes:
        return rows.sparkSession.createDataFrame([], HIT_TYPES)
    dealt, lanes, chunk_rows = _lanes(queries.select("query_id", "asked", "looks"), asking, LANES, most_queries or CHUNK_ROWS)
    parts = _parts(sum(sizes.values()), row_bytes)

    def packed(batches):
        lane = TaskContext.get().partitionId() % lanes
        for t in _packs(batches, chunk_rows, None):
            yield _one(CHUNKS, lane, uuid.uuid4().hex, t.column("query_id").to_pylist(), _bytes(t, "asked"), _bytes(t, "looks"))

    def scan(batches):
        name = chunk = None
        for row in _each(batches):
            if (new := row["chunk"].as_py()) != name:
                if chunk is not None:
                    yield from chunk.hits()
                ids, asked = _asked(row, query_type)
                looks = np.frombuffer(row["looks"].as_buffer(), np.uint8).reshape(len(ids), -1)
                name, chunk = new, Chunk(ids, asked, np.unpackbits(looks, axis=1)[:, :cells].astype(bool), k)
            cell = row["cell"].as_py()
            chunk.meet(cell, vectors(cell, row["data"].as_buffer()), row["ids"].values)
        if chunk is not None:
            yield from chunk.hits()

    chunks = dealt.mapInArrow(packed, "lane int, chunk string, qids array<string>, asked binary, looks binary")
    return _pairs(chunks, lanes, _blocks(rows, sizes, block_rows or BLOCK_ROWS, parts), parts).mapInArrow(scan, HIT_TYPES)


def best_listed(rows: DataFrame, held: int, queries: DataFrame, asking: int, k: int, query_type: type,
                vectors: Callable[[bytes], np.ndarray], row_bytes: int) -> DataFrame:
    """The k rows with the largest products with every query, of those listed for it, once for each part of the rows:
    (query_id, tile_id, score).

    `rows` is (tile_id, data), `held` of them; `queries` is (query_id, asked, listed), the ids of rows.
    """
    if not held:
        return rows.sparkSession.createDataFrame([], HIT_TYPES)
    dealt, lanes, chunk_rows = _lanes(queries.select("query_id", "asked", "listed"), asking, LISTED_LANES, LISTED_CHUNK_ROWS)
    parts = _parts(held, row_bytes)

    def packed(batches):
        lane = TaskContext.get().partitionId() % lanes
        for t in _packs(batches, chunk_rows, None):
            listed = t.column("listed").to_pylist()
            yield _one(LISTED, lane, uuid.uuid4().hex, t.column("query_id").to_pylist(), _bytes(t, "asked"), [len(x) for x in listed], [i for x in listed for i in x])

    def scan(batches):
        name = chunk = None
        for row in _each(batches):
            if (new := row["chunk"].as_py()) != name:
                if chunk is not None:
                    yield from chunk.hits()
                name, chunk = new, Chunk(*_asked(row, query_type), None, k)
                owner = np.repeat(np.arange(len(chunk.qids)), row["sizes"].values.to_numpy())
                listed = row["listed"].values.dictionary_encode()
                place = {x: i for i, x in enumerate(listed.dictionary.to_pylist())}
                of = listed.indices.to_numpy()
                by = np.argsort(of, kind="stable")
                owner, edge = owner[by], np.searchsorted(of[by], np.arange(len(place) + 1))
            ids, m = row["ids"].values, vectors(row["data"].as_buffer())
            at = np.array([place.get(x, -1) for x in ids.to_pylist()])
            mine = np.flatnonzero(at >= 0)
            first, n = edge[at[mine]], np.diff(edge)[at[mine]]
            b = np.repeat(mine, n)
            q = owner[np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            for i in range(0, len(b), SENT_ROWS):
                some, to = q[i:i + SENT_ROWS], b[i:i + SENT_ROWS]
                chunk.take(some, to, np.einsum("ij,ij->i", chunk.asked[some], m[to].astype(np.float64, copy=False)), ids)
            if 2 * chunk.waits >= chunk.rounded.size:
                chunk.merge()
        if chunk is not None:
            yield from chunk.hits()

    chunks = dealt.mapInArrow(packed, "lane int, chunk string, qids array<string>, asked binary, sizes array<int>, listed array<string>")
    blocks = _blocks(rows.withColumn("cell", F.lit(0)), {0: held}, LISTED_BLOCK_ROWS, parts)
    return _pairs(chunks, lanes, blocks, parts).mapInArrow(scan, HIT_TYPES)

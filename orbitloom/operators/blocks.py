"""Every base row against every query row, as bounded blocks of matrix work.

Vector search and in-full ranking need all base x query scores but never all
those rows: each block reduces to a few rows per query before any shuffle.
A query side that fits the byte limit and is small beside the base is broadcast;
otherwise both sides are cut into a grid of (base block, query block) cells, each
of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

QUERY_BYTES_LIMIT = 64 * 1024 * 1024
BASE_BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 2048
SMALL_QUERY_BLOCK_ROWS = 256


def _in_blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def block_apply(
    base: DataFrame,
    queries: DataFrame,
    reduce_block: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    base_key: str,
    query_key: str,
    query_row_bytes: int,
    query_bytes_limit: int = QUERY_BYTES_LIMIT,
    base_rows: int | None = None,
) -> DataFrame:
    """Apply `reduce_block(base block, query block)` to every pair of blocks.

    With `base_rows`, a base block has about so many rows, and the base is dealt out by them where queries are many.

    `query_row_bytes` is an upper estimate of one query row; it turns the byte
    limit into a row limit.  At most that many rows (plus one) are ever fetched.
    """
    row_limit = max(1, query_bytes_limit // query_row_bytes)
    head = queries.limit(row_limit + 1).toPandas()
    n_head = len(head)
    n_base_rows = base.count() if n_head > 2 * SMALL_QUERY_BLOCK_ROWS else None
    cores = base.sparkSession.sparkContext.defaultParallelism
    block_rows = base_rows or BASE_BLOCK_ROWS
    if n_head <= row_limit and (n_base_rows is None or n_base_rows >= 4 * n_head):
        shared = base.sparkSession.sparkContext.broadcast(head)

        def run(batches):
            q = shared.value
            for block in _in_blocks(batches, block_rows):
                for at in range(0, len(q), QUERY_BLOCK_ROWS):
                    yield reduce_block(block, q.iloc[at:at + QUERY_BLOCK_ROWS].reset_index(drop=True))

        if base_rows and n_base_rows:  # the partitions of a scan don't tell the work of their rows
            base = base.repartition(max(cores, -(-n_base_rows // base_rows)))
        return base.mapInPandas(run, schema)

    n_query_rows = n_head if n_head <= row_limit else queries.count()
    n_base = max(1, -(-(base.count() if n_base_rows is None else n_base_rows) // block_rows))
    # large query blocks copy the base least; smaller ones are used only while there are fewer cells than cores
    n_query = max(1, -(-n_query_rows // QUERY_BLOCK_ROWS), min(-(-n_query_rows // SMALL_QUERY_BLOCK_ROWS), -(-4 * cores // n_base)))
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("_bb", F.pmod(F.xxhash64(base_key), F.lit(n_base)).cast("int")).withColumn("_qb", seq(n_query))
    # fresh column identities: both sides may come from the same table, and a cogroup confuses shared ones
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    right = queries.withColumn("_qb", F.pmod(F.xxhash64(query_key), F.lit(n_query)).cast("int")).withColumn("_bb", seq(n_base))

    def cell(_key, b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if b.empty or q.empty:
            return reduce_block(b.iloc[:0], q.iloc[:0])
        return reduce_block(b.reset_index(drop=True), q.reset_index(drop=True))

    # cells are heavy in work but light in bytes: a fixed partition count keeps them from being merged into few tasks
    tasks = min(n_base * n_query, 32 * cores)
    spread = lambda df: df.repartition(tasks, "_bb", "_qb").groupBy("_bb", "_qb")
    return spread(left).cogroup(spread(right)).applyInPandas(cell, schema)

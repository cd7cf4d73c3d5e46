"""Continuous forms: incremental indexing and audit windows."""

from __future__ import annotations

import os
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.catalog import latest_per_key
from ..operators.embedding import Encoder, encode_texts
from ..operators.incremental import classify
from ..session import materialize, new_table_path


class KeyedTable:
    """A keyed Parquet table, partitioned by a hash of its keys; a merge rewrites the partitions that it touches.

    `buckets` is chosen so that one partition is a comfortable task.  Merging the same rows twice leaves the same
    table, so a batch may be retried.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self._with_bucket(spark.createDataFrame([], schema)).write.mode("append").parquet(path)

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema + ", bucket INT").parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def merge(self, rows: DataFrame) -> None:
        """Upserts `rows`, one per key.  Only the touched buckets are read and written: their numbers, at most
        `buckets`, are all that passes through the driver."""
        new = materialize(self._with_bucket(rows), "merge")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        old = self._stored().where(F.col("bucket").isin(touched)).join(new.select(*self.keys), self.keys, "left_anti")
        merged = materialize(old.select(*new.columns).unionByName(new), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


BATCH_ROWS, STATE_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000  # whole texts that a Python worker holds at a time
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestArrival(StatefulProcessor):
    """Lets an arrival of a key through if it is newer than all before it, whatever batch it comes in.

    The state of a key is the newest (order, hash).  With `keep_ms` a timer forgets a key so long after its newest arrival.
    """

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "newest string, content_hash string, forget_at long")

    @staticmethod
    def _order(value) -> str:
        """A text that sorts like the arrival's number or time."""
        n = value.value if isinstance(value, pd.Timestamp) else int(value)
        return f"{n + (1 << 63):020d}"

    def handleInputRows(self, key, rows, timerValues):
        best = None
        for pdf in rows:
            order = pdf["arrived_at"].map(self._order)
            at = (order + pdf["content_hash"]).idxmax()
            mine = (order[at], pdf.at[at, "content_hash"])
            if best is None or mine > best[0]:
                best = (mine, pdf.loc[[at]])
        if best is None or (self.held.exists() and tuple(self.held.get())[:2] >= best[0]):
            return
        forget_at = 0
        if self.keep_ms is not None:
            forget_at = int(best[1]["arrived_at"].iloc[0].value // 1_000_000) + self.keep_ms
            self.handle.registerTimer(forget_at)
        self.held.update((*best[0], forget_at))
        yield best[1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a newer arrival has set a later timer
        if self.held.exists() and self.held.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def newest_arrivals(arrivals: DataFrame, keep_ms: int | None = None, late: str | None = None) -> DataFrame:
    """The rows of a stream (tile_id, content, arrived_at, content_hash) that are newer by (arrived_at, content_hash) than all that
    came before them.  State is one short row per tile, for ever or, with `keep_ms`, until the watermark (`late` behind) is
    that far beyond the tile's newest arrival; `arrived_at` is a timestamp then."""
    rows = arrivals.select("tile_id", "content", "arrived_at", "content_hash")
    if keep_ms is not None:
        rows = rows.withWatermark("arrived_at", late or "0 seconds")
    return rows.groupBy("tile_id").transformWithStateInPandas(
        NewestArrival(keep_ms), outputStructType=rows.schema, outputMode="Append", timeMode="None" if keep_ms is None else "EventTime")


def index_stream(arrivals: DataFrame, manifest: KeyedTable, vectors: KeyedTable, encoder: Encoder, checkpoint: str,
                 stamp="2024-01-01 00:00:00", keep_ms: int | None = None, late: str | None = None):
    """Index arriving tiles (tile_id, content, and optionally arrived_at) as they come; unchanged content is skipped.

    Of all arrivals of a tile, in one batch or in several and in any order, the last by arrived_at wins (equal times: the larger
    content hash): keyed state lets only newer ones through (see `newest_arrivals` for `keep_ms` and `late`).  Without that
    column the last micro-batch wins, and in it the larger hash.  Rows without a tile id or content are left out.  Every micro-batch is
    diffed against the manifest by hash and model version.  Runs what is available and stops; call again for the next files.
    """
    def step(batch: DataFrame, _batch_id: int) -> None:
        if "arrived_at" not in batch.columns:
            batch = batch.withColumn("arrived_at", F.lit(0))
        last = latest_per_key(batch, ["tile_id"], ["arrived_at", "content_hash"])
        todo = materialize(classify(last, manifest.read(), encoder.name, encoder.version).where(F.col("change") != "UNCHANGED"), "todo")
        at = F.lit(stamp).cast("timestamp")
        encoded = encode_texts(todo.select("tile_id", F.col("content").alias("_content")), "_content", encoder)
        vectors.merge(encoded.select(
            "tile_id", F.lit(encoder.name).alias("model_name"), F.lit(encoder.version).alias("model_version"),
            F.lit(encoder.dim).alias("vector_dim"), at.alias("created_at"), "embedding",
        ))
        # the manifest goes last: a failure before it makes the retry encode again, never skip
        manifest.merge(todo.select(
            "tile_id", "content_hash", F.lit(encoder.name).alias("embedding_model"),
            F.lit(encoder.version).alias("embedding_version"), at.alias("indexed_at"),
        ))

    rows = arrivals.where("tile_id IS NOT NULL AND content IS NOT NULL").withColumn("content_hash", F.sha2("content", 256))
    if "arrived_at" in arrivals.columns:
        rows = newest_arrivals(rows.where("arrived_at IS NOT NULL"), keep_ms, late)
    spark = arrivals.sparkSession
    with _conf(spark, PROVIDER, ROCKS), _conf(spark, BATCH_ROWS, str(STATE_BATCH_ROWS)):  # a query keeps the settings it is started with
        return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def windowed_latency(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Query counts and latency sums per type and tumbling window; state older than the watermark is dropped."""
    return (
        log.withWatermark("created_at", late).groupBy(F.window("created_at", width), "query_type")
        .agg(F.count("*").alias("queries"), F.sum("latency_ms").alias("latency_sum"))
        .select(F.col("window.start").alias("window_start"), "query_type", "queries", "latency_sum")
    )


def user_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: bursts of queries separated by at least the gap."""
    return (
        log.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), "user_id")
        .agg(F.count("*").alias("queries"))
        .select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "queries")
    )


def run_to_table(stream: DataFrame, keys: list[str], label: str, mode: str = "update") -> DataFrame:
    """Run an aggregate stream over what is available into a table in the shared folder and read it back,
    the newest value of each key."""
    spark = stream.sparkSession
    path, checkpoint = new_table_path(spark, label), new_table_path(spark, label + "-checkpoint")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(path, f"b={batch_id}"))

    q = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(path).drop("b")
    return latest_per_key(rows, keys, ["_batch"]).drop("_batch")

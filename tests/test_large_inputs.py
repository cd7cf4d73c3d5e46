"""Work is dealt out by rows, and what a task holds at a time is bounded."""

import numpy as np
from pyspark.sql import functions as F

from orbitloom.functions import projection as P
from orbitloom.operators import knn, quantised as Q
from orbitloom.sources.tables import spread


def test_rows_of_a_file_with_few_row_groups_are_dealt_out(spark, tmp_path):
    """A scan has as many partitions as its bytes ask for, and one row group puts all rows into one of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"k": np.random.default_rng(1).integers(0, 1 << 62, 200_000)}), tmp_path / "t.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        scan = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert scan.rdd.getNumPartitions() > 20
        sizes = [r["count"] for r in spread(scan, 20_000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 200_000 and max(sizes) <= 25_000


def test_staged_degrees_are_those_of_the_series(spark):
    rows = [(f"EPSG:32{h}{z:02d}", 2e5 + 37_000.0 * z, 1e6 + 91_000.0 * z) for h in (6, 7) for z in (0, 1, 31, 46, 60, 61)]
    rows += [("EPSG:4326", 91.0, 26.0), (None, 1.0, 2.0), ("EPSG:3857", 3.0, 4.0), ("epsg:32646", 3e5, 2.9e6), ("EPSG:32646", None, 2.9e6)]
    df = spark.createDataFrame(rows, "crs string, e double, n double").repartition(1)
    lon, lat = P.to_degrees("crs", "e", "n")
    want = [tuple(r) for r in df.select("crs", "e", "n", lon.alias("lon"), lat.alias("lat")).collect()]
    staged = P.with_degrees(df, "crs", {("lon", "lat"): ("e", "n"), ("lon2", "lat2"): ("n", "e")})
    assert staged.columns == ["crs", "e", "n", "lon", "lat", "lon2", "lat2"]
    assert [tuple(r) for r in staged.select("crs", "e", "n", "lon", "lat").collect()] == want


def test_a_search_block_is_scored_some_queries_at_a_time(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(2)
    b = pd.DataFrame({"tile_id": [f"b{i:03d}" for i in range(200)], "embedding": list(rng.normal(size=(200, 8)))})
    q = pd.DataFrame({"query_id": [f"b{i:03d}" for i in range(100)], "embedding": list(rng.normal(size=(100, 8)))})
    held, round_ = [], np.round
    monkeypatch.setattr(knn.np, "round", lambda x, n: held.append(x.size) or round_(x, n))
    some = knn._block_top(b, q, 5, True)
    assert max(held) <= knn.SCAN_ROWS * 200
    monkeypatch.setattr(knn, "SCAN_ROWS", 1_000)
    whole = knn._block_top(b, q, 5, True)
    assert some[["query_id", "tile_id"]].equals(whole[["query_id", "tile_id"]]) and np.allclose(some["score"], whole["score"])


def test_queries_are_repeated_for_their_cells_a_few_at_a_time():
    import pandas as pd

    rng = np.random.default_rng(3)
    asked = pd.DataFrame({"query_id": [f"q{i:03d}" for i in range(300)], "embedding": list(rng.normal(size=(300, 8)))})
    parts = list(Q.probed([asked], rng.normal(size=(20, 8)), np.arange(20), 15))
    assert max(len(p) for p in parts) <= Q.SCAN_ROWS * 15
    every = pd.concat(parts)
    assert len(every) == 300 * 15 and (every.groupby("query_id")["block"].nunique() == 15).all()


def test_the_index_stream_starts_with_small_batches(spark, tmp_path):
    """Whole texts go through the Python workers of the keyed state; the session's own setting comes back."""
    from orbitloom import schemas
    from orbitloom.operators.embedding import HashingEncoder
    from orbitloom.streaming import incremental as ST

    seen, enc, before = [], HashingEncoder(8), spark.conf.get(ST.BATCH_ROWS)
    tables = [ST.KeyedTable(spark, str(tmp_path / n), s, k, buckets=2) for n, s, k in (
        ("m", schemas.INDEX_MANIFEST, ["tile_id", "embedding_model"]), ("v", schemas.VECTORS, ["tile_id", "model_name"]))]
    spark.createDataFrame([("t1", "river", 1)], "tile_id string, content string, arrived_at long").write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema("tile_id string, content string, arrived_at long").parquet(str(tmp_path / "in"))
    merge = tables[1].merge
    tables[1].merge = lambda rows: (seen.append(rows.sparkSession.conf.get(ST.BATCH_ROWS)), merge(rows))
    ST.index_stream(arrivals, *tables, enc, str(tmp_path / "ck")).awaitTermination()
    assert seen == [str(ST.STATE_BATCH_ROWS)] and spark.conf.get(ST.BATCH_ROWS) == before
    assert [r.tile_id for r in tables[1].read().collect()] == ["t1"]

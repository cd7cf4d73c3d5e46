import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitloom import schemas
from orbitloom.operators import audit as A, evaluate as EV, incremental as I, pairs as PR, ranking as RK
from orbitloom.operators.embedding import HashingEncoder
from orbitloom.session import materialize
from orbitloom.sources import tables as S
from orbitloom.streaming import incremental as ST


# ---- files

def test_scene_files_and_class_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.tif", "a.tiff", "c.png", "deep/d.tif"):
        (tmp_path / name).write_bytes(name.encode())
    names = lambda r: sorted(x.path.rsplit("/", 1)[1] for x in S.scene_files(spark, str(tmp_path), r).select("path").collect())
    assert names(False) == ["a.tiff", "b.tif"] and names(True) == ["a.tiff", "b.tif", "d.tif"]
    hashed = I.content_hash(S.scene_files(spark, str(tmp_path)))
    import hashlib
    assert {r.content_hash for r in hashed.collect()} == {hashlib.sha256(n).hexdigest() for n in (b"b.tif", b"a.tiff")}
    for cls in ("Forest", "River"):
        (tmp_path / "cls" / cls).mkdir(parents=True)
        (tmp_path / "cls" / cls / f"{cls}_1.jpg").write_bytes(b"x")
    got = sorted((r.class_name, r.tile_id) for r in S.class_folder(spark, str(tmp_path / "cls")).collect())
    assert got == [("Forest", "Forest_Forest_1"), ("River", "River_River_1")]


def test_scene_manifest_replaces_one_key(spark, tmp_path):
    row = lambda k, w: tuple([k] + ["x"] * 6 + [w, 1, 4, "p", 10, "r", "l", "t", "v"])
    S.write_scene_manifest(spark.createDataFrame([row("a", 1), row("b", 2)], schemas.SCENE_MANIFEST), str(tmp_path / "m"))
    new = S.replace_in_manifest(S.read_scene_manifest(spark, str(tmp_path / "m")), spark.createDataFrame([row("b", 9)], schemas.SCENE_MANIFEST))
    assert sorted((r.scene_id, r.width) for r in new.collect()) == [("a", 1), ("b", 9)]


def test_relevance_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("query_id,query,tile_id,relevant\nq1,a,t1,1\nq1,a,t2,0\nq1,a,t1,0\nq2,b,t3,0\n")
    once, sizes = S.relevance_sets(S.read_relevance(spark, str(tmp_path / "r.csv")))
    assert {r.query_id: (r.relevant_count, r.non_relevant_count) for r in sizes.collect()} == {"q1": (1, 1), "q2": (0, 1)}
    hits = spark.createDataFrame([("q1", "t9", 1), ("q1", "t1", 2), ("q2", "t3", 1)], "query_id string, tile_id string, rank int")
    m = EV.per_query_metrics(EV.judged_hits(hits, once), sizes).collect()
    assert len(m) == 1 and (m[0].recall_1, m[0].recall_5, m[0].precision_5, m[0].reciprocal_rank, m[0].top_3) == (0.0, 1.0, 0.2, 0.5, "t9,t1")
    assert EV.metric_means(EV.per_query_metrics(EV.judged_hits(hits, once), sizes)).first().mrr == 0.5
    S.write_report(EV.metric_means(EV.per_query_metrics(EV.judged_hits(hits, once), sizes)), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).first().mrr == 0.5


def test_pair_manifest_and_corpus(spark, tmp_path):
    doc = {"metadata": {"total_pairs": 3}, "pairs": [{"tile_id": "a", "caption": "x", "label": 1}, {"tile_id": "b", "caption": "y"}, {"tile_id": "c", "caption": "z", "label": 0}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=2))
    assert sorted(r.tile_id for r in S.read_pairs(spark, str(tmp_path / "p.json")).collect()) == ["a", "b"]
    assert S.read_pairs(spark, str(tmp_path / "p.json"), positive_only=False).count() == 3
    corpus = {"images": [{"filename": "i1.jpg", "split": "train", "sentences": [{"raw": "a"}, {"raw": ""}, {"raw": "b"}, {"raw": "c"}, {"raw": "d"}]},
                         {"filename": "i2.jpg", "split": "test", "sentences": [{"raw": "e"}]}, {"filename": "i3.jpg", "sentences": [{"raw": "f"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    images = S.read_caption_corpus(spark, str(tmp_path / "c.json"))
    assert [(r.tile_id, r.caption, r.split) for r in S.flatten_captions(images).collect()] == [
        ("i1", "a", "train"), ("i1", "b", "train"), ("i1", "c", "train"), ("i2", "e", "val"), ("i3", "f", "train")]
    assert S.flatten_captions(images, max_samples=1).count() == 3
    pairs = S.flatten_captions(images)
    S.write_pairs(pairs, str(tmp_path / "out"))
    assert (tmp_path / "out" / "pairs" / "split=val").exists()
    meta = {r.split: r.total_pairs for r in spark.read.json(str(tmp_path / "out" / "metadata")).collect()}
    assert meta == {"train": 4, "val": 1}


def test_vector_store_roundtrip_append_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "tile_id string, embedding array<float>")
    S.save_vectors(df, str(tmp_path / "v"))
    assert S.lookup(S.load_vectors(spark, str(tmp_path / "v")), "tile_id", "b").first().embedding == [3.0, 4.0]
    S.append(df.select("tile_id"), str(tmp_path / "log"))
    S.append(df.select("tile_id"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


# ---- ranks under skew

def test_exact_percentiles_on_a_hot_key(spark):
    df = spark.range(60000).selectExpr("IF(id % 3 < 2, 'hot', concat('k', id % 7)) AS k", "pow(id * 7919 % 60013, 1.3) AS x")
    got = {r.k: r for r in RK.exact_percentiles(df, ["k"], "x", [0.5, 0.95, 0.0, 1.0]).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        want = np.percentile(g["x"], [50, 95, 0, 100])
        assert np.allclose([got[k].p50, got[k].p95, got[k].p0, got[k].p100], want, rtol=1e-12) and got[k].n == len(g)


def test_hash_ranks_are_dense_and_repeatable(spark):
    df = spark.range(9000).selectExpr("concat('t', id) AS tile_id")
    a = {r.tile_id: r.rank for r in RK.hash_ranked(df, ["tile_id"], 5).collect()}
    b = {r.tile_id: r.rank for r in RK.hash_ranked(df.repartition(3), ["tile_id"], 5).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 9001))


def test_splits(spark):
    pairs = spark.range(400).selectExpr("concat('t', id % 40) AS tile_id", "id", "1 AS label", "'x' AS caption")
    s = PR.split_by_tile(pairs, 0.15, 42)
    per_tile = s.groupBy("tile_id").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert per_tile == 1 and s.where("split = 'val'").select("tile_id").distinct().count() == 6 and s.count() == 400
    one = PR.split_by_tile(pairs.where("id < 3"), 0.15, 1)
    assert one.where("split = 'val'").select("tile_id").distinct().count() == 1
    rows = PR.split_by_row(pairs, ["id"], 0.15, 1)
    assert rows.where("split = 'val'").count() == 60
    assert PR.split_by_row(pairs, ["id"], 0.15, 1, at_least=100).where("split = 'val'").count() == 100
    parts = PR.captions_by_tile(pairs.withColumn("caption", F.col("id").cast("string")).withColumn("tile_id", F.lit("hot")), chunk=50)
    assert parts.agg(F.sum(F.size("captions"))).first()[0] == 400 and parts.count() > 4


@pytest.mark.parametrize("v,w,b,s,t,want", [
    (0.5, -0.5, 0.2, 0.1, 0.2, ["dense_vegetation"]), (0.4, -0.5, 0.2, 0.1, 0.05, ["sparse_vegetation", "agricultural"]), (0.0, 0.2, 0.5, 0.1, 0.0, ["water", "built_up"]),
    (0.0, -0.01, 0.15, 0.1, 0.0, ["bare_soil", "water"]), (0.17, -0.5, 0.31, 0.1, 0.09, ["built_up"]), (0.17, -0.5, 0.31, 0.1, 0.08, ["mixed"]), (0.18, -0.2, 0.8, 0.01, 0.0, ["cloud_or_haze"]),
])
def test_land_cover(spark, v, w, b, s, t, want):
    df = spark.createDataFrame([("t", v, w, b, s, t)], "tile_id string, ndvi_mean double, ndwi_mean double, brightness_mean double, brightness_std double, texture_mean double")
    assert [c["class"] for c in PR.land_cover_scores(df).first().land_covers] == want


# ---- incremental

def test_manifest_rules(spark):
    cur = spark.createDataFrame([(f"tile_{i}", f"h{i}") for i in range(4)] + [("tile_5", None)], "tile_id string, content_hash string")
    man = spark.createDataFrame([("tile_0", "h0", "m", "v1"), ("tile_1", "old", "m", "v1"), ("tile_2", "h2", "m", "v0"), ("tile_3", "h3", "other", "v1")],
                                "tile_id string, content_hash string, embedding_model string, embedding_version string")
    got = {r.tile_id: r.change for r in I.classify(cur, man, "m", "v1").collect()}
    assert got == {"tile_0": "UNCHANGED", "tile_1": "MODIFIED", "tile_2": "MODIFIED", "tile_3": "NEW"}


def test_stream_indexes_once_and_survives_a_retry(spark, tmp_path):
    enc = HashingEncoder(16)
    man = ST.KeyedTable(spark, str(tmp_path / "man"), schemas.INDEX_MANIFEST, ["tile_id", "embedding_model"])
    vec = ST.KeyedTable(spark, str(tmp_path / "vec"), schemas.VECTORS, ["tile_id", "model_name"])
    src = tmp_path / "in"

    def arrive(rows, n):
        spark.createDataFrame(rows, "tile_id string, content string").coalesce(1).write.mode("append").parquet(str(src))
        q = ST.index_stream(spark.readStream.schema("tile_id string, content string").parquet(str(src)), man, vec, enc, str(tmp_path / "ck"), f"2024-01-0{n} 00:00:00")
        q.awaitTermination()

    arrive([("a", "river"), ("b", "forest")], 1)
    first = {r.tile_id: r.embedding for r in vec.read().collect()}
    arrive([("b", "forest"), ("a", "city"), ("c", "port")], 2)
    days = {r.tile_id: r.indexed_at.day for r in man.read().collect()}
    second = {r.tile_id: r.embedding for r in vec.read().collect()}
    assert days == {"a": 2, "b": 1, "c": 2}  # unchanged b was skipped
    assert second["b"] == first["b"] and second["a"] != first["a"] and len(second) == 3
    # the same rows merged again leave one row of each key
    before = sorted(map(tuple, man.read().collect()))
    man.merge(materialize(man.read().where("tile_id = 'c'"), "again"))
    assert sorted(map(tuple, man.read().collect())) == before


def test_the_last_arrival_wins(spark, tmp_path):
    man = ST.KeyedTable(spark, str(tmp_path / "man"), schemas.INDEX_MANIFEST, ["tile_id", "embedding_model"], buckets=3)
    vec = ST.KeyedTable(spark, str(tmp_path / "vec"), schemas.VECTORS, ["tile_id", "model_name"], buckets=3)
    rows = [("a", "v1-old", 1), ("a", "v2-new", 2), ("b", "z", 5), ("b", "y", 9), ("b", "x", 7)]
    schema = "tile_id string, content string, arrived_at long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    ST.index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), man, vec, HashingEncoder(16), str(tmp_path / "ck")).awaitTermination()
    import hashlib

    assert {r.tile_id: r.content_hash for r in man.read().collect()} == {"a": hashlib.sha256(b"v2-new").hexdigest(), "b": hashlib.sha256(b"y").hexdigest()}
    assert vec.read().count() == 2


def test_an_older_arrival_in_a_later_batch_changes_nothing(spark, tmp_path):
    """Two batches in the wrong order, then a newer one again; with and without a time after which a tile is forgotten."""
    import hashlib

    text = "tile_id string, content string, arrived_at timestamp"
    for name, keep in (("always", None), ("forgets", 3_600_000)):
        man = ST.KeyedTable(spark, str(tmp_path / name / "man"), schemas.INDEX_MANIFEST, ["tile_id", "embedding_model"], buckets=3)
        vec = ST.KeyedTable(spark, str(tmp_path / name / "vec"), schemas.VECTORS, ["tile_id", "model_name"], buckets=3)
        src = str(tmp_path / name / "in")

        def arrive(rows, day):
            spark.createDataFrame(rows, "tile_id string, content string, t string").selectExpr("tile_id", "content", "to_timestamp(t) AS arrived_at").coalesce(
                1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(text).parquet(src)
            ST.index_stream(stream, man, vec, HashingEncoder(16), str(tmp_path / name / "ck"), f"2024-01-0{day} 00:00:00", keep, "30 minutes").awaitTermination()
            return {r.tile_id: (r.content_hash, r.indexed_at.day) for r in man.read().collect()}

        h = lambda x: hashlib.sha256(x.encode()).hexdigest()
        first = arrive([("a", "new a", "2024-01-01 10:00:00"), ("b", "b", "2024-01-01 10:00:00"), (None, "x", "2024-01-01 10:00:00")], 1)
        assert first == {"a": (h("new a"), 1), "b": (h("b"), 1)}
        second = arrive([("a", "old a", "2024-01-01 09:50:00"), ("c", "c", "2024-01-01 09:50:00"), ("a", "older a", "2024-01-01 09:45:00")], 2)
        assert second == first | {"c": (h("c"), 2)}
        vectors = {r.tile_id: r.embedding for r in vec.read().collect()}
        assert vectors["a"] == HashingEncoder(16).encode(["new a"])[0].astype("float32").tolist()
        third = arrive([("a", "newest a", "2024-01-01 12:30:00"), ("b", "b", "2024-01-01 12:30:00")], 3)
        assert third == second | {"a": (h("newest a"), 3)}


def test_windows_and_sessions_stream(spark, tmp_path):
    rows = [("click", 1.0, f"2024-01-01 00:{m:02d}:00", u) for m, u in ((0, 1), (5, 1), (50, 1), (10, 2))]
    spark.createDataFrame(rows, "query_type string, latency_ms double, t string, user_id long").withColumn("created_at", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema("query_type string, latency_ms double, user_id long, created_at timestamp").parquet(str(tmp_path / "log"))
    w = ST.run_to_table(ST.windowed_latency(stream(), "30 minutes"), ["window_start", "query_type"], "w")
    assert sorted(r.queries for r in w.collect()) == [1, 3]
    batch = ST.user_sessions(spark.read.parquet(str(tmp_path / "log")))
    assert sorted((r.user_id, r.queries) for r in batch.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_audit_rows_repeat_their_ids(spark):
    df = spark.createDataFrame([("k", "SEARCH", "text", None, [1.0], None, None, "S", 3, 1.5, "2024-01-01")],
                               "query_key string, query_type string, query_text string, query_tile_id string, bbox array<double>, date_from string, date_to string, sensor string, result_count int, latency_ms double, created_at string")
    a, b = A.query_log_rows(df).first(), A.query_log_rows(df).first()
    assert a == b and a.query_id.startswith("q-") and len(a.query_id) == 66
    assert json.loads(a.filters) == {"bbox": [1.0], "date_from": None, "date_to": None, "sensor": "S"}


def test_contrastive_loss_against_numpy(spark):
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, t = unit(rng.normal(size=(6, 8))), unit(rng.normal(size=(6, 8)))
    df = spark.createDataFrame([(0, i, a[i].tolist(), t[i].tolist()) for i in range(6)], "batch long, item long, image array<double>, text array<double>")
    r = EV.contrastive_batches(df).first()
    z = a @ t.T / 0.07
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    target = np.full((6, 6), 0.1 / 6) + 0.9 * np.eye(6)
    assert abs(r.loss_i2t + (target * logp).sum(axis=1).mean()) < 1e-9
    assert r.accuracy_i2t == (z.argmax(axis=1) == np.arange(6)).mean()


def test_percentiles_of_a_whole_table(spark):
    df = spark.range(30001).selectExpr("pow(id * 7919 % 30011, 1.1) AS x")
    got = RK.exact_percentiles(df, [], "x", [0.5, 0.95]).first()
    x = df.toPandas()["x"]
    assert np.allclose([got.p50, got.p95, got["mean"]], [*np.percentile(x, [50, 95]), x.mean()], rtol=1e-12) and got.n == 30001


def test_resolve_paths(spark):
    tiles = spark.createDataFrame([("a", "x/a.tif"), ("b", "x/b.tif"), ("c", "x/c.tif"), ("d", "x/d.tif")], "tile_id string, file_path string")
    files = spark.createDataFrame([("x/a.tif",), ("data/public/tiles/a.tif",), ("data/public/x/b.tif",), ("data/public/tiles/c.jpg",), ("data/public/tiles/c.png",)], "path string")
    got = {r.tile_id: r.found_path for r in S.resolve_paths(tiles, files).collect()}
    assert got == {"a": "x/a.tif", "b": "data/public/x/b.tif", "c": "data/public/tiles/c.png", "d": None}

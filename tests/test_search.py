import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitloom.functions import vector as V
from orbitloom.functions.querytext import parse_queries
from orbitloom.operators import embedding as E, knn, rerank as R
from orbitloom.plans import search as P


def parse(spark, *texts, tile=None):
    df = spark.createDataFrame([(t, tile) for t in texts], "text string, tile string")
    rows = parse_queries(df, "text", "tile").collect()
    return rows[0] if len(rows) == 1 else rows


@pytest.mark.parametrize("text,tile,intent", [
    ("what has changed in this area", None, "CHANGE_ANALYSIS"),
    ("Find locations similar to this site", "tile_1", "IMAGE_SIMILARITY"),
    ("Where did this data come from and what is the provenance trace", None, "PROVENANCE"),
    ("Find water bodies, rivers and surrounding dense forest", None, "SEMANTIC_SEARCH"),
    ("xyz", None, "SEMANTIC_SEARCH"),
])
def test_intents(spark, text, tile, intent):
    assert parse(spark, text, tile=tile).intent == intent


def test_full_extraction(spark):
    r = parse(spark, "Show flood damage in Assam between July and August 2024 with cloud cover < 15%")
    assert (r.location, r.date_from, r.date_to, r.max_cloud_cover, r.cleaned_prompt) == ("Assam", "2024-07-01", "2024-08-31", 15.0, "flood damage")
    assert (r.bbox_minx, r.bbox_maxy, r.is_change_query) == (89.70, 28.00, True)


def test_extraction_rules(spark):
    r = parse(spark, "ships near Delhi NCR during Feb 2024 landsat")
    assert (r.location, r.date_from, r.date_to, r.sensor) == ("Delhi", "2024-02-01", "2024-02-29", "Landsat-8")
    r = parse(spark, "fields [1, -2.5, 3, 4] after 2024-05-01")
    assert (r.bbox_minx, r.bbox_miny, r.date_from, r.date_to) == (1.0, -2.5, "2024-05-01", None)
    r = parse(spark, "fields until 2024-05-01")
    assert (r.date_from, r.date_to) == (None, "2024-05-01")
    r = parse(spark, "from 2024-01-02 to 2023-05-06 in March 2025")
    assert (r.date_from, r.date_to) == ("2024-01-02", "2023-05-06")
    r = parse(spark, "between foo and bar 2024 sargasso")
    assert (r.date_from, r.sensor) == (None, "Sentinel-1")
    r = parse(spark, "changes after May 2024")
    assert (r.date_from, r.date_to) == (None, None)
    assert parse(spark, "in assam").cleaned_prompt == "in assam"  # too short once stripped
    assert parse(spark, "  show me  Kerala  rivers ,. ").cleaned_prompt == "rivers"


def unit_rows(n, seed, dim=512):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, vectors, name):
    return spark.createDataFrame([(f"{name}{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "tile_id string, embedding array<double>")


def as_queries(df):
    return df.select(F.col("tile_id").alias("query_id"), "embedding")


def test_self_is_nearest_and_excluded(spark):
    t = table(spark, unit_rows(5, 42), "tile_")
    top = knn.nearest(t, as_queries(t), 1, 512).collect()
    assert all(r.query_id == r.tile_id and abs(r.score - 1) < 1e-9 for r in top) and len(top) == 5
    sim = knn.similar_to(t, t.where("tile_id = 'tile_0000'"), 20, 512).collect()
    assert len(sim) == 4 and all(r.tile_id != "tile_0000" for r in sim)  # k above the table size


@pytest.mark.parametrize("limit", [64 << 20, 200])
def test_block_grid_and_broadcast_agree_with_numpy(spark, limit, monkeypatch):
    from orbitloom.operators import blocks

    monkeypatch.setattr(blocks, "BASE_BLOCK_ROWS", 37)
    monkeypatch.setattr(blocks, "QUERY_BLOCK_ROWS", 11)
    b, q = unit_rows(300, 1, 16), unit_rows(40, 2, 16)
    got = knn.nearest(table(spark, b, "b"), as_queries(table(spark, q, "q")), 7, 16, query_bytes_limit=limit).collect()
    want = np.argsort(-(q @ b.T), axis=1)[:, :7]
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, {})[r.rank] = r.tile_id
    for i in range(40):
        assert [lists[f"q{i:04d}"][k] for k in range(1, 8)] == [f"b{j:04d}" for j in want[i]]


def test_literal_query_plans_a_distributed_top_k(spark):
    t = table(spark, unit_rows(20, 3, 8), "t")
    plan = knn.nearest_one(t, [1.0] + [0.0] * 7, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_approximate_recall(spark):
    rng = np.random.default_rng(5)
    centers = unit_rows(8, 9, 16)
    v = centers[rng.integers(0, 8, 600)] + 0.1 * rng.normal(size=(600, 16))
    t = table(spark, v / np.linalg.norm(v, axis=1, keepdims=True), "t")
    exact = {(r.query_id, r.tile_id) for r in knn.nearest(t, as_queries(t), 5, 16).collect()}
    near = {(r.query_id, r.tile_id) for r in knn.nearest_by_cells(t, as_queries(t), 5, 16, cells=8, probes=3).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_registered_search_reaches_its_recall(spark):
    """The registered search itself and the library default, not a setting of their own."""
    from workload import search as S

    d = "/root/testdata/sf0.001"
    exact = {(r.query_id, r.tile_id) for r in S.nearest_tiles(spark, d).collect()}
    base, asked = S._vectors(spark, d), S._as_queries(spark, d)
    for hits in (S.approximate_neighbours(spark, d), knn.nearest_by_cells(base, asked, 10, S.DIM)):
        found = {(r.query_id, r.tile_id) for r in hits.collect()}
        wanted = {x for x in exact if x[0] in {i for i, _ in found}}
        assert len(wanted & found) >= 0.9 * len(wanted)
    assert {r.query_id for r in S.approximate_neighbours(spark, d).collect()} == {r.query_id for r in S._twentieth(spark, d).collect()}


def test_unit_ensemble_and_calibration(spark):
    r = spark.range(1).select(
        V.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.unit(F.array(F.lit(0.0))).alias("z"),
        V.ensemble(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).alias("e"),
        *[V.text_confidence(F.lit(s)).alias(f"t{i}") for i, s in enumerate((0.15, 0.33, -1.0))],
        *[V.image_confidence(F.lit(s)).alias(f"i{i}") for i, s in enumerate((0.45, 0.95, 2.0))],
    ).first()
    assert r.u == [0.6, 0.8] and r.z is None and abs(r.e[0] - 2 ** -0.5) < 1e-12
    assert (r.t0, r.t1, r.t2, r.i0, r.i1, r.i2) == (0.5, 0.98, 0.5, 0.5, 0.98, 0.98)


def test_encoder_interface(spark):
    enc = E.HashingEncoder(32)
    v = enc.encode(["River Delta", "", "river delta"])
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-12 and not v[1].any() and (v[0] == v[2]).all()
    df = E.encode_texts(spark.createDataFrame([("a", "river"), ("b", None)], "k string, t string"), "t", enc)
    assert [len(r.embedding) for r in df.collect()] == [32, 32]
    ens = E.encode_prompts(spark.createDataFrame([("river",), ("",)], "t string"), "t", enc).collect()
    assert abs(np.linalg.norm(ens[0].embedding) - 1) < 1e-9 and ens[1].embedding is None


def test_domain_walk(spark):
    """A confirming domain wins over earlier and later contradictions; else the last contradiction speaks."""
    rows = [("q1", "urban solar", "t1", "BHADLA_SOLAR_PARK", 0.3), ("q2", "urban forest", "t1", "BHADLA_SOLAR_PARK", 0.3), ("q3", "sky", "t1", "X", 0.02), ("q4", "sky", "t1", "X", 0.06)]
    df = spark.createDataFrame(rows, "query_id string, text string, tile_id string, scene_id string, raw_similarity double")
    got = {r.query_id: r for r in R.rerank(df, 5).collect()}
    assert got["q1"].is_strongly_aligned and got["q1"].vlm_reasoning.startswith("Confirmed high-density geometric photovoltaic")
    assert not got["q2"].is_strongly_aligned and got["q2"].vlm_reasoning == "Suppressed false match: Arid terrain or dense concrete built-up surface."
    assert 0.35 <= got["q2"].similarity < 0.45
    assert not got["q3"].is_strongly_aligned and got["q3"].similarity == 0.73 and "73.0%" in got["q3"].vlm_reasoning
    assert got["q4"].is_strongly_aligned and got["q4"].similarity >= 0.965


def test_query_suite(spark, scenes_and_tiles):
    scenes, tiles = scenes_and_tiles
    enc = E.HashingEncoder(32)
    tiles = E.encode_texts(tiles.withColumn("about", F.concat(F.lit("flood damage "), "tile_id")), "about", enc)
    texts = ["photovoltaic solar panel arrays in desert", "flood damage in Assam", "mumbai port container terminal docks", "airport runway", "dense forest green canopy",
             "urban city buildings", "mangrove delta tidal river", "Show flood damage in Assam between July and August 2024 with cloud cover < 15%"]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")
    top = {r.query_id: r for r in P.semantic_search(q, tiles, scenes, enc, 1).collect()}
    assert "q0" in top and "q1" in top and "q2" not in top  # Mumbai's box holds no tile
    assert "q7" not in top  # nothing acquired in July or August


def test_a_text_asked_by_most_users_is_scored_once(spark, scenes_and_tiles):
    scenes, tiles = scenes_and_tiles
    enc = E.HashingEncoder(32)
    tiles = E.encode_texts(tiles.withColumn("about", F.concat(F.lit("river "), "tile_id")), "about", enc)
    q = spark.range(60).selectExpr("concat('q', id) AS query_id", "IF(id % 3 < 2, 'river in guwahati', concat('forest ', id)) AS text")
    assert P.parsed_requests(q).select("request_id").distinct().count() == 21
    rows = P.semantic_search(q, tiles, scenes, enc, 5).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.query_id, []).append((r["rank"], r.tile_id, r.similarity))
    hot = {tuple(sorted(v)) for k, v in lists.items() if int(k[1:]) % 3 < 2}
    assert len(lists) == 60 and len(hot) == 1 and len(next(iter(hot))) == 5
    assert all(not t.endswith("_2") for _, t, _ in next(iter(hot)))  # outside the Guwahati box


def test_dates_between_the_same_days_are_one_search(spark, scenes_and_tiles, monkeypatch):
    """Three hundred limits, three days of scenes: equal texts and limits that the same tiles pass are searched once."""
    import datetime

    scenes, tiles = scenes_and_tiles
    enc = E.HashingEncoder(32)
    tiles = E.encode_texts(tiles.withColumn("about", F.concat(F.lit("forest "), "tile_id")), "about", enc)
    days = [str(datetime.date(2023, 12, 20) + datetime.timedelta(n)) for n in range(300)]
    texts = {f"{w}{d}": f"forest {w} {d}" for d in days for w in ("since", "until")}
    texts |= {"both": "forest 2024-02-01 2024-08-31", "april": "forest 2024-04-10 2024-04-10", "any": "forest canopy", "none": None, "blank": "  "}
    rows = [(f"{q}-{n}", t, s) for q, t in texts.items() for n, s in enumerate((None, "", "sentinel-2"))]
    q = spark.createDataFrame(rows, "query_id string, text string, given string")
    seen, search = [], P.R.search_blocks

    def counted(base, requests, *args):
        seen.append(requests.count())
        return search(base, requests, *args)

    monkeypatch.setattr(P.R, "search_blocks", counted)
    got = {}
    for r in P.semantic_search(q, tiles, scenes, enc, 100, {"sensor": "given"}).collect():
        got.setdefault(r.query_id, set()).add(r.tile_id)
    of = {r.scene_id: (r.sensor.lower(), str(r.d) if r.d else "") for r in scenes.select("scene_id", "sensor", F.col("acquisition_date").alias("d")).collect()}
    of = {r.tile_id: of[r.scene_id] for r in tiles.select("tile_id", "scene_id").collect()}
    limits = {f"since{d}": (d, "") for d in days} | {f"until{d}": ("", d) for d in days} | {"both": ("2024-02-01", "2024-08-31"), "april": ("2024-04-10", "2024-04-10"), "any": ("", "")}
    want = {}
    for name, (lo, hi) in limits.items():
        for n, sensor in enumerate(("", "", "sentinel-2")):
            pass_ = {t for t, (s, d) in of.items() if (not lo or d >= lo > "") and (not hi or "" < d <= hi) and (not sensor or s == sensor)}
            if pass_:
                want[f"{name}-{n}"] = pass_
    assert {k: v for k, v in got.items() if not k.startswith("blank")} == want
    assert seen[0] <= 2 * (3 + 3 + 2 + 2), seen  # with and without a sensor: days from, days to, both, any text


def test_best_rows_are_those_of_the_full_order():
    rng = np.random.default_rng(7)
    for n, k in ((0, 3), (2, 3), (50, 3), (50, 50), (400, 20)):
        raw = rng.integers(0, 6, n) / 10
        score, ids = np.clip(raw, 0.2, 0.4), rng.permutation(n)
        raw[::7] = np.nan
        score[::7] = np.nan
        assert R.best_rows(score, raw, ids, k).tolist() == np.lexsort((ids, -raw, -score))[:k].tolist()


def test_recall_is_measured_for_every_tile(spark, tmp_path):
    """Every tile is a query, and a tile that comes twice counts an exact neighbour once for each of its rows."""
    from workload import search as S

    rng = np.random.default_rng(11)
    v = np.repeat(unit_rows(42, 10, S.DIM), 10, axis=0) + 0.05 * rng.normal(size=(420, S.DIM))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in r], i % 10) for i, r in enumerate(v)]
    for name, some in (("once", rows), ("twice", rows + rows[:7])):
        spark.createDataFrame(some, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert tuple(S.neighbour_recall(spark, f"{tmp_path}/{name}").first()) == (4200, True, True, True)

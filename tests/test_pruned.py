"""Exact search with bounds against the full product, and what the bounds save."""

import numpy as np
import pytest

from orbitloom.operators import pruned as P, quantised as Q


def table(spark, rows, name, key):
    return spark.createDataFrame([(f"{name}{i:05d}", r.tolist()) for i, r in enumerate(rows)], f"{key} string, embedding array<double>")


def full(base, asked, k, own=False):
    scores = np.round(asked @ base.T, 6)
    if own:
        np.fill_diagonal(scores, -np.inf)
    out = set()
    for i, s in enumerate(scores):
        order = np.lexsort((np.arange(len(base)), -s))[:min(k, len(base) - own)]
        out |= {(i, int(b), r + 1, round(float(s[b]), 6)) for r, b in enumerate(order)}
    return out


def found(hits):
    return {(int(r.query_id[1:]), int(r.tile_id[1:]), r["rank"], round(r.score, 6)) for r in hits.collect()}


def clustered(rng, groups, per, dim, spread):
    centers = rng.normal(size=(groups, dim))
    m = np.repeat(centers / np.linalg.norm(centers, axis=1, keepdims=True), per, axis=0) + spread * rng.normal(size=(groups * per, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("BLOCK_ROWS", 25), ("PIECE_ROWS", 10), ("CHUNK_ROWS", 7), ("BOUND_ROWS", 16)):
        monkeypatch.setattr(P, name, n)


def test_rows_of_the_full_search(spark, small_blocks):
    rng = np.random.default_rng(1)
    base = clustered(rng, 12, 40, 8, 0.1)
    base[7] = base[300]  # equal scores rank by id
    base *= rng.uniform(0.2, 3.0, size=(len(base), 1))  # norms differ
    asked = np.concatenate([base[::9], rng.normal(size=(20, 8)), np.zeros((1, 8))])
    index = P.build(table(spark, base, "b", "tile_id"), block_rows=25)
    assert len(index.blocks.number) > 10 and index.blocks.size.sum() == len(base)
    for k in (1, 7, 1000):
        assert found(P.nearest(index, table(spark, asked, "q", "query_id"), k)) == full(base, asked, k)


def test_self_is_left_out(spark, small_blocks):
    rng = np.random.default_rng(2)
    base = clustered(rng, 5, 30, 6, 0.2)
    b = table(spark, base, "b", "tile_id")
    assert found(P.nearest(b, b.withColumnRenamed("tile_id", "query_id"), 4, exclude_self=True)) == full(base, base, 4, own=True)


def test_share_of_scored_pairs_falls_with_clusters(spark):
    rng = np.random.default_rng(3)
    shares = []
    for spread in (0.02, 0.1, 1.0):
        m = clustered(rng, 30, 80, 16, spread)
        index = P.build(table(spark, m, "b", "tile_id"), block_rows=60)
        row = P.scored_share(index, table(spark, m[::20], "q", "query_id"), 10).first()
        assert row["pairs"] == row["queries"] * row["blocks"] == 120 * len(index.blocks.number)
        shares.append(P.share_of(row))
    assert shares[0] < 0.1 and shares[0] < shares[1] < shares[2]


def test_bounds_hold_for_every_row(spark):
    rng = np.random.default_rng(4)
    base = clustered(rng, 9, 50, 7, 0.3) * rng.uniform(0.5, 2.0, size=(450, 1))
    index = P.build(table(spark, base, "b", "tile_id"), block_rows=20)
    of = {r.tile_id: r.block for r in index.rows.collect()}
    place = np.searchsorted(index.blocks.number, [of[f"b{i:05d}"] for i in range(len(base))])
    asked = rng.normal(size=(40, 7)) * 3
    upper, lower = index.blocks.bounds(asked)
    scores = asked @ base.T
    assert (scores <= upper[:, place]).all() and (scores >= lower[:, place]).all()


def test_match_rank_counts_skipped_blocks(spark, small_blocks):
    rng = np.random.default_rng(5)
    images = clustered(rng, 10, 30, 8, 0.1)
    texts = images * 0.6 + 0.4 * images[np.roll(np.arange(300), 1)]
    texts[::50] = rng.normal(size=(6, 8))
    scores = np.round(texts @ images.T, 6)
    want = {}
    for i, s in enumerate(scores):
        want[i] = 1 + int((s > s[i]).sum() + (s[:i] == s[i]).sum())
    named = table(spark, texts, "b", "query_id")
    assert {int(r.query_id[1:]): r["rank"] for r in P.match_rank(table(spark, images, "b", "tile_id"), named).collect()} == want


def test_vectors_without_clusters_are_sent_to_units_and_not_to_blocks(spark):
    """What is sent grows with the units, of which there are few, whatever the number of blocks that are looked into."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(600, 32))
    index = P.build(table(spark, m, "b", "tile_id"), block_rows=15)
    hits, near, rest = P._search(index, table(spark, m[::4], "q", "query_id"), 5, False)
    blocks, units = len(index.blocks.number), len(set(P.units_of(index.blocks).tolist()))
    assert blocks > 20 and units == 1
    looked = near.unionByName(rest).agg({"n": "sum"}).first()[0]
    assert looked > 10 * 150 and near.count() + rest.count() <= 2 * 150 * units
    assert found(hits) == full(m, m[::4], 5)


def test_single_precision_decides_nothing(spark):
    """Scores that differ in the sixth decimal only, of long vectors, and scores beyond the range of single precision."""
    rng = np.random.default_rng(9)
    m = np.repeat(rng.normal(size=(6, 24)) * 40, 40, axis=0)
    m[:, 0] += rng.integers(0, 6, 240) * 1e-7
    base, asked = table(spark, m, "b", "tile_id"), table(spark, m[::8], "q", "query_id")
    assert found(P.nearest(base, asked, 7)) == full(m, m[::8], 7)
    far = np.array([[1e25, 0.0], [0.0, 1e25], [-1e25, 1.0]])
    assert [(r.query_id, r.tile_id) for r in P.nearest(table(spark, far, "b", "tile_id"), table(spark, far[:1], "q", "query_id"), 1).collect()] == [("q00000", "b00000")]


def test_no_rows(spark):
    none = spark.createDataFrame([], "tile_id string, embedding array<double>")
    one = spark.createDataFrame([("q0", [1.0, 0.0]), ("q1", None)], "query_id string, embedding array<double>")
    assert P.nearest(none, one, 3).collect() == []
    base = spark.createDataFrame([("b0", [1.0, 0.0]), ("b1", None)], "tile_id string, embedding array<double>")
    assert [(r.query_id, r.tile_id) for r in P.nearest(base, one, 3).collect()] == [("q0", "b0")]
    assert P.nearest(base, one.where("query_id = 'x'"), 3).collect() == []


# ---- compressed index

def test_compressed_recall_and_exact_scores(spark):
    """At least 0.9 of the exact neighbours, true scores, every row coded, pieces of any size."""
    rng = np.random.default_rng(6)
    base = np.concatenate([clustered(rng, 20, 60, 16, 0.2), rng.normal(size=(300, 16)) / 4])
    asked = base[::15]
    index = Q.build(table(spark, base, "b", "tile_id"))
    assert sum(index.sizes.values()) == index.codes.count() == len(base)
    q = table(spark, asked, "q", "query_id")
    got = found(Q.nearest(index, q, 10))
    want = full(base, asked, 10)
    assert len({(a, b) for a, b, *_ in got} & {(a, b) for a, b, *_ in want}) >= 0.9 * len(want)
    assert all(abs(s - asked[a] @ base[b]) < 2e-6 for a, b, _, s in got)
    assert {r for _, _, r, _ in got} == set(range(1, 11)) and len(got) == 10 * len(asked)
    listed = Q.shortlist(index, q, 40)
    assert listed.groupBy("query_id").count().agg({"count": "max"}).first()[0] == 40 <= len(base) / 5


def test_all_rows_listed_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(Q, "PIECE_ROWS", 30)
    monkeypatch.setattr(Q, "CHUNK_ROWS", 9)
    rng = np.random.default_rng(7)
    base = clustered(rng, 6, 30, 10, 0.3)  # the last part has two dimensions
    asked = rng.normal(size=(25, 10))
    index = Q.build(table(spark, base, "b", "tile_id"))
    assert found(Q.nearest(index, table(spark, asked, "q", "query_id"), 5, size=1000, probe_share=1.0)) == full(base, asked, 5)


def test_compressed_without_rows(spark):
    none = spark.createDataFrame([], "tile_id string, embedding array<double>")
    assert Q.nearest(Q.build(none), spark.createDataFrame([("q0", [1.0])], "query_id string, embedding array<double>"), 3).collect() == []

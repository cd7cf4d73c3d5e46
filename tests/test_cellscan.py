"""Rows of cells and the queries that look into them: exact results, and no copies per pair of blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitloom.operators import cellscan as C, knn, quantised as Q

from test_pruned import clustered, found, full, table


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK_ROWS", 20), ("CHUNK_ROWS", 30), ("SMALL_CHUNK", 9), ("STRIP_ROWS", 4), ("SENT_ROWS", 50), ("PART_BYTES", 9_000),
                    ("LISTED_BLOCK_ROWS", 25), ("LISTED_CHUNK_ROWS", 12), ("LANES", 4), ("LISTED_LANES", 3)):
        monkeypatch.setattr(C, name, n)


def exchanged(df):
    """Rows of every shuffle of an executed plan."""
    df.collect()
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(p.plan())
        else:
            if kind == "ShuffleExchangeExec":
                out.append(int(p.metrics().apply("shuffleRecordsWritten").value()))
            children = p.children()
            left += [children.apply(i) for i in range(children.size())]
    return out


def test_rows_of_the_full_search(spark, small):
    rng = np.random.default_rng(1)
    base = clustered(rng, 12, 30, 8, 0.1)
    base[7] = base[300]  # equal scores rank by id
    base[40:90] = base[40]
    base *= rng.uniform(0.2, 3.0, size=(len(base), 1))
    asked = np.concatenate([base[::6], rng.normal(size=(20, 8)), np.zeros((1, 8))])
    for k in (1, 7, 1000):
        hits = knn.nearest_by_cells(table(spark, base, "b", "tile_id"), table(spark, asked, "q", "query_id"), k, 8, cells=6, probes=6)
        assert found(hits) == full(base, asked, k)


def test_neither_side_is_written_per_block_of_the_other(spark, small):
    """Only hits of a part grow with both sides; rows and queries are shuffled once, and then as packs, once per lane and part."""
    rng = np.random.default_rng(2)
    m = clustered(rng, 8, 60, 8, 0.2)
    hits = knn.nearest_by_cells(table(spark, m, "b", "tile_id"), table(spark, m, "q", "query_id"), 2, 8, cells=4, probes=4)
    parts = -(-480 * (8 * 8 + 32) // C.PART_BYTES)
    assert parts > 2 and found(hits) == full(m, m, 2)
    moved = exchanged(hits)
    assert max(moved) <= 480 * 2 * parts and sum(moved) <= 480 * 2 * parts + 2 * 480 + 480, moved
    assert "CartesianProduct" not in hits._jdf.queryExecution().executedPlan().toString()


def test_only_cells_that_are_asked_for(spark, small):
    rng = np.random.default_rng(3)
    base, asked = rng.normal(size=(200, 5)), rng.normal(size=(70, 5))
    cell, look = rng.integers(0, 11, 200), np.stack([rng.permutation(11)[:3] for _ in range(70)])
    rows = spark.createDataFrame([(f"b{i:05d}", int(c), x.tobytes()) for i, (c, x) in enumerate(zip(cell, base, strict=True))], "tile_id string, cell int, data binary")
    queries = spark.createDataFrame(
        [(f"q{i:05d}", x.tobytes(), b) for i, (x, b) in enumerate(zip(asked, C.look_bits(look, 11), strict=True))], "query_id string, asked binary, looks binary")
    sizes = {int(c): int(n) for c, n in zip(*np.unique(cell, return_counts=True), strict=True)}
    hits = knn.rank_hits(C.best_in_cells(rows, sizes, queries, 70, 11, 6, np.float64, lambda _, data: np.frombuffer(data, np.float64).reshape(-1, 5), 72), 6)
    want = set()
    for i in range(70):
        s = np.where(np.isin(cell, look[i]), np.round(base @ asked[i], 6), -np.inf)
        want |= {(i, int(b), r + 1, round(float(s[b]), 6)) for r, b in enumerate(np.lexsort((np.arange(200), -s))[:6]) if np.isfinite(s[b])}
    assert found(hits) == want


def met(base, asked, k, rows=16, ids=None):
    chunk = C.Chunk(pa.array([f"q{i}" for i in range(len(asked))]), asked, np.ones((len(asked), 1), bool), k)
    ids = [f"b{i:05d}" for i in range(len(base))] if ids is None else ids
    for at in range(0, len(base), rows):
        chunk.meet(0, base[at:at + rows], pa.array(ids[at:at + rows], pa.string()))
    return {i: [r["tile_id"] for b in chunk.hits() for r in b.to_pylist() if r["query_id"] == f"q{i}"] for i in range(len(asked))}


def test_single_precision_decides_nothing():
    rng = np.random.default_rng(4)
    m = np.repeat(rng.normal(size=(6, 24)) * 40, 40, axis=0)
    m[:, 0] += rng.integers(0, 6, 240) * 1e-7
    for base in (m, m.astype(np.float32), m * 1e20, m * 1e-12):
        wide = base.astype(np.float64)
        scores = np.round(wide[::8] @ wide.T, 6)
        want = {i: [f"b{b:05d}" for b in np.lexsort((np.arange(240), -s))[:7]] for i, s in enumerate(scores)}
        if abs(wide).max() < 1e15:  # beyond it the sixth decimal is under the error of double precision
            assert met(base, base[::8], 7) == want
        else:
            assert {i: len(x) for i, x in met(base, base[::8], 7).items()} == {i: 7 for i in want}


def test_scores_that_are_no_numbers_never_qualify():
    base = np.array([[1.0, 0.0], [np.nan, 0.0], [0.5, 0.0], [np.inf, 0.0], [-1.0, 0.0], [1e200, 0.0]])
    assert met(base, np.array([[1.0, 1.0], [np.nan, 1.0]]), 3, rows=2) == {0: ["b00005", "b00000", "b00002"], 1: []}


def test_a_missing_id_comes_first_among_equals():
    assert met(np.ones((4, 2)), np.ones((1, 2)), 3, rows=2, ids=[None, "", "a", "b"])[0] == [None, "", "a"]


def test_no_rows(spark):
    none = spark.createDataFrame([], "tile_id string, cell int, data binary")
    asked = spark.createDataFrame([("q", b"\0" * 8, b"\1")], "query_id string, asked binary, looks binary").where(F.lit(True))
    assert C.best_in_cells(none, {}, asked, 1, 1, 3, np.float64, lambda _, data: np.zeros((0, 1)), 8).collect() == []


def test_listed_rows_are_scored_and_no_others(spark, small):
    """A row that comes twice is met twice, missing ids never, and a query without a list has no hits."""
    rng = np.random.default_rng(5)
    base, asked = rng.normal(size=(120, 4)), rng.normal(size=(40, 4))
    lists = [sorted(rng.choice(120, size=int(n), replace=False).tolist()) for n in rng.integers(0, 30, 40)]
    named = [(f"b{i:05d}", x.tobytes()) for i, x in enumerate(base)] + [("b00003", base[3].tobytes()), (None, base[4].tobytes())]
    rows = spark.createDataFrame(named, "tile_id string, data binary")
    queries = spark.createDataFrame(
        [(f"q{i:05d}", x.tobytes(), [f"b{j:05d}" for j in some] + ["unknown"]) for i, (x, some) in enumerate(zip(asked, lists, strict=True))],
        "query_id string, asked binary, listed array<string>")
    hits = C.best_listed(rows, len(named), queries, 40, 6, np.float64, lambda data: np.frombuffer(data, np.float64).reshape(-1, 4), 64)
    got = {}
    for r in knn.rank_hits(hits, 6).collect():
        got.setdefault(int(r.query_id[1:]), []).append((r["rank"], int(r.tile_id[1:]), round(r.score, 6)))
    for i, some in enumerate(lists):
        want = sorted(((-round(float(base[j] @ asked[i]), 6), j) for j in some + [3] * (3 in some)))[:6]
        assert sorted(got.get(i, [])) == [(r + 1, j, -s) for r, (s, j) in enumerate(want)]


def test_the_short_lists_of_all_rows_are_no_copies_of_vectors(spark, small):
    """Queries are sent once, not once per cell, and neither side's vectors once per listed row; a given list is not made again."""
    rng = np.random.default_rng(6)
    m = clustered(rng, 10, 60, 8, 0.2)
    index = Q.build(table(spark, m, "b", "tile_id"))
    asked = table(spark, m, "q", "query_id")
    listed = Q.shortlist(index, asked, 20)
    parts = -(-600 * (2 + 32) // C.PART_BYTES)
    assert len(index.sizes) > 4 and parts > 1 and listed.count() == 600 * 20
    moved = exchanged(listed)
    assert sum(moved) <= 600 * 20 * parts + 2 * 600 + 600, moved
    hits = Q.nearest(index, asked, 3, listed=listed)
    vectors = -(-600 * (8 * 8 + 32) // C.PART_BYTES)
    moved = exchanged(hits)
    assert sum(moved) <= 600 * 20 * parts + 600 * 3 * vectors + 6 * 600, moved
    assert found(hits) == found(Q.nearest(index, asked, 3, size=20))
    assert len(found(hits) & full(m, m, 3)) >= 0.9 * 600 * 3

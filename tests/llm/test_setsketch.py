import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orbitloom.llm import setsketch as S
from orbitloom.llm import words as W


def brute_sets(texts):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = dict(zip([i for i, _ in rows], brute_sets([t for _, t in rows]), strict=True))
    low = {i: i for i in sets}
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return {i: len(s) for i, s in sets.items()}, low


def test_words_and_shingles_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB \t\n\x0b\x1cö🚀") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["", None]
    assert [len(s) for s in S.shingle_sets(pa.array(texts))] == [len(s) for s in brute_sets(texts)]


def test_estimate_follows_the_true_similarity():
    rng = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.75, 0.9):
        n = 1_000
        both = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)))) for _ in range(2))
        ra, rb = S.registers_of(a)[None], S.registers_of(b)[None]
        got = S.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))[0]
        assert got == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)), abs=0.1)


def test_sketches_merge():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    assert S.merge(S.registers_of(a).tobytes(), S.registers_of(b).tobytes()) == S.registers_of(np.union1d(a, b)).tobytes()


def near_copies(rng, groups, size, words=120, edits=8):
    rows, n = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, edits)):
                copy[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = near_copies(random.Random(4), 6, 40) + [(10_000, "a b c"), (10_001, "a b c"), (10_002, None), (10_003, "")]
    sizes, low = brute_components(rows)
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == low
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    """Chains of copies, and pieces so small that every band takes several cells."""
    monkeypatch.setattr(S, "SMALL_BAND", 2)
    monkeypatch.setattr(S, "CELL", 2_000)
    rng = random.Random(5)
    rows = near_copies(rng, 2, 60, edits=14)
    sizes, low = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == low


def counting(link, rows):
    def run(cell):
        rows.add(cell.num_rows)
        return link(cell)
    return run


def test_members_of_a_crowd_are_placed_in_proportion_to_their_number(spark, monkeypatch):
    """Near copies of one text and, whatever their number, six texts beside them that share its bands but are not linked."""
    monkeypatch.setattr(S, "CELL", 2_000)
    link = S.link_cell
    made = []
    for size in (60, 120):
        rng = random.Random(6)
        base = [f"w{i}" for i in range(120)]
        rows = [(0, " ".join(base))]
        for n in range(1, size):
            copy = list(base)
            for _ in range(1 if n > 6 else 9):
                copy[rng.randrange(120)] = f"x{n}y{rng.randrange(10_000)}"
            rows.append((n, " ".join(copy)))
        placed = spark.sparkContext.accumulator(0)

        monkeypatch.setattr(S, "link_cell", counting(link, placed))
        got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_components(rows)[1] and len(set(got.values())) > 1
        made.append(placed.value)
    assert 0 < made[0] and made[1] <= 2.5 * made[0], made
    assert made[1] <= 10 * 120, made  # once for a block of those that ask, and not once for each of its bands


def test_a_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1_000, 1_001), (2_000, 2_000)]
    got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1_000: 1_000, 1_001: 1_000}


def test_awkward_rows(awkward, nothing):
    got = S.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] in (1, 6)) == [(1, 1), (6, 1), (6, 1)]
    assert all(r["kept"] and r["n_shingles"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert S.near_duplicates(nothing).count() == 0
    kept = S.keep_one(awkward.selectExpr("doc_id", "text", "7 AS n", "8 AS id", "9 AS component_id"))
    assert kept.columns == ["doc_id", "text", "n", "id", "component_id"] and kept.count() == awkward.count() - 2

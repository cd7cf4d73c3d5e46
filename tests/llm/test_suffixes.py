"""Repeated byte windows against a table of all of them."""

import random
from collections import Counter

import numpy as np
import pytest

from orbitloom.llm import suffix_windows as W


def brute(texts, depth=400):
    """(n_bytes, spans, kept) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - depth + 1):
            if seen[d[i:i + depth]] > 1:
                gone[i:i + depth] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(int)))
        out.append((len(d), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkläß") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [prose(150) for _ in range(4)]
    texts = [prose(rng.randrange(5, 200)) for _ in range(20)]
    texts += [prose(rng.randrange(30)) + s[:rng.randrange(380, 900)] + prose(rng.randrange(30)) for s in shared for _ in range(6)]
    long = prose(500)
    for _ in range(12):  # near copies
        ws = long.split(" ")
        for _ in range(4):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        texts.append(" ".join(ws))
    texts += [texts[0], texts[3], texts[3]]  # copies
    texts += ["x" * 1500, "x" * 399, "ab" * 400, prose(90) + "x" * 401, "abc" * 134]  # repetition within a text
    texts += [None, "", "é" * 200, "é" * 200 + "e", shared[0][:400], shared[0][1:401]]
    return texts


def rows_of(df):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    texts = made_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r[0]: r[1:] for r in rows_of(W.drop_repeated_windows(docs))}
    want = brute(texts)
    assert sum(bool(s) for _, s, _ in want) > 30
    for i, row in enumerate(want):
        assert got[i] == row, i


def test_broadcast_groups_change_nothing(spark, monkeypatch):
    texts = made_texts(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(rows_of(W.drop_repeated_windows(docs)))
    for hot in (1, 1_000_000):  # no group is hot, every group is
        monkeypatch.setattr(W, "HOT", hot)
        assert sorted(rows_of(W.drop_repeated_windows(docs))) == want


def test_pieces_and_groups_change_nothing(monkeypatch):
    data = np.frombuffer("\n".join(t or "" for t in made_texts(4)).encode(), np.uint8)
    offsets = np.array([0, 500, 500, 5_000, 5_200, len(data)])
    whole = W.anchored(data, offsets)
    monkeypatch.setattr(W, "PIECE", 777)
    assert all((a == b).all() for a, b in zip(whole, W.anchored(data, offsets), strict=True))


def test_awkward_rows(spark, awkward, nothing):
    """Repeated rows are repetitions of each other, with or without an id; extra columns don't matter."""
    passage = " ".join(f"p{i}" for i in range(150))
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(None, passage), (None, passage), (20, "a"), (20, passage + "!")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(str((i, *w)) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True))
    extra = docs.selectExpr("*", "1 AS id1", "2 AS grams", "3 AS places", "4 AS masks", "5 AS spans", "6 AS kept", "7 AS n")
    assert sorted(map(str, rows_of(W.drop_repeated_windows(extra)))) == want
    assert W.drop_repeated_windows(nothing).collect() == []


def test_query(spark, tmp_path):
    import hashlib

    from orbitloom.llm.queries import op13_suffix_dedup

    texts = made_texts(7)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op13_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (n, spans, kept) in enumerate(brute(texts)):
        assert got[i] == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())

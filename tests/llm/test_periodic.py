"""Periodic runs against every stretch looked at one by one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orbitloom.llm import periodic_runs as P


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(ws):
    """(start, period, length) of maximal stretches with smallest period q and a length of at least max(6, 4 q)."""
    found = set()
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            start = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            size = i - start + q
            part = ws[start:start + size]
            if size >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((start, q, size))
            i = max(i, start + 1)
    return sorted(found)


def brute_rest(ws):
    runs = brute_runs(ws)
    return " ".join(w for i, w in enumerate(ws) if not any(s + q <= i < s + size for s, q, size in runs))


def made_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kinds = rng.choice([1, 2, 3, 10, 100])
        ws = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(120))]
        if ws and rng.random() < 0.6:
            a, p = rng.randrange(len(ws)), rng.randrange(1, 20)
            ws = [w if i < a else ws[min(a + (i - a) % p, len(ws) - 1)] for i, w in enumerate(ws)]
        out.append(rng.choice([" ", "\n", " \t "]).join(ws))
    return out


def test_runs_and_rest_are_those_of_brute_force():
    texts = [*made_texts(1500, 3), None, "", "  ", "one", "a " * 5, "a " * 6, "ä ö " * 9]
    rows = [r for part in P.find_in(pa.array(texts)) for r in part.to_pylist()]
    assert len(rows) == len(texts)
    for text, row in zip(texts, rows, strict=True):
        ws = words(text)
        assert [(r["start"], r["period"], r["length"]) for r in row["runs"]] == brute_runs(ws)
        assert row["collapsed"] == brute_rest(ws) and row["n_words"] == len(ws)


@pytest.mark.parametrize("step", [1, -1])
def test_grammar_counts_equal_symbols(step):
    rng = np.random.default_rng(5)
    for kinds, n in ((1, 300), (2, 400), (3, 1000), (50, 1000)):
        code = rng.integers(0, kinds, n)
        code[n // 2:] = code[:n - n // 2]  # the second half is the first one
        symbols = np.concatenate(([kinds], code, [kinds + 1]))
        wall = np.zeros(n + 2, bool)
        wall[[0, -1]] = True
        a = rng.integers(1, n, 400)
        b = a + rng.integers(1, n + 1 - a)
        got = P.Grammar(symbols, wall).equal(a, b, step)
        for x, y, size in zip(a, b, got, strict=True):
            k = 0
            while symbols[x + k * step] == symbols[y + k * step]:
                k += 1
            assert size == k


def test_group_borders_do_not_matter(monkeypatch):
    texts = made_texts(120, 8)
    whole = [r for part in P.find_in(pa.array(texts)) for r in part.to_pylist()]
    monkeypatch.setattr(P, "GROUP_BYTES", 300)
    monkeypatch.setattr(P, "CANDIDATES", 50)
    assert [r for part in P.find_in(pa.array(texts)) for r in part.to_pylist()] == whole


def test_a_long_text_of_one_period():
    row = next(P.find_in(pa.array(["x y z " * 50_000]))).to_pylist()[0]
    assert row["runs"] == [{"start": 0, "length": 150_000, "period": 3}] and row["collapsed"] == "x y z"


def test_awkward_rows(spark, awkward, nothing):
    rows = P.find_runs(awkward.selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS n_words")).collect()
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    assert sorted(map(str, ((r.doc_id, r.collapsed) for r in rows))) == sorted(
        str((r.doc_id, brute_rest(words(r.text)))) for r in awkward.collect()) and texts
    assert P.find_runs(nothing).collect() == []


def test_query_on_a_small_table(spark, tmp_path):
    """The query's planted repetitions and digests, by the contract's words."""
    import hashlib
    import zlib

    from orbitloom.llm.queries import op12_periodic_runs

    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(i * 3 % 140))) for i in range(150)] + [(150, None), (151, " a  b ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    for doc_id, text in texts:
        ws, h = words(text), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words(text))
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs, row = brute_runs(ws), rows[doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, q, size in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_rest(ws).encode()).hexdigest()
        best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=(None, None, None))
        assert (row.start, row.period, row.length) == best
        assert row.exponent_milli == (1000 * best[2] // best[1] if runs else None)
    assert any(r.n_runs for r in rows.values())

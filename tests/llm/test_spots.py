import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from orbitloom.llm import spots as S


def brute_signatures(text):
    """Anchors with the two content words after them, by plain Python."""
    import re

    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    anchors = set(S.ANCHORS.split())
    out = set()
    for i, w in enumerate(low):
        rest = [x for x in low[i + 1:] if x not in anchors][:2]
        if w in anchors and len(rest) == 2:
            out.add((w, *rest))
    if not out:
        out = {tuple(low[i:i + 3]) for i in range(len(low))}
    return out


def random_text(rng, n):
    words = S.ANCHORS.split()[:12] + [f"c{i}" for i in range(40)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_signatures_are_those_of_brute_force():
    rng = random.Random(1)
    texts = [random_text(rng, rng.randrange(0, 80)) for _ in range(120)] + ["", "the", "plain words only here"]
    texts += [" ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(1, 60))) + " the x y z" for _ in range(60)]
    for text, got in zip(texts, S.signature_sets(pa.array(texts), S.anchor_hashes()), strict=True):
        assert len(got) == len(brute_signatures(text))


def test_content_words_are_no_anchors():
    text = "of one two " + " ".join(f"w{i}" for i in range(40)) + " the x z"
    [got] = S.signature_sets(pa.array([text]), S.anchor_hashes())
    assert len(got) == 2


@pytest.mark.parametrize("floor", [0.0, 0.5, 0.75])
def test_pruning_changes_nothing_at_or_above_the_floor(floor):
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 60)).astype(np.uint32)) for _ in range(2))
        union = len(np.union1d(a, b))
        exact = len(np.intersect1d(a, b)) / union if union else 1.0
        got = S.pruned_jaccard(a, b, floor)
        assert got == exact if exact >= floor else got in (0.0, exact)


def test_alike_sets_lie_in_equal_or_neighbouring_ranges():
    for n in range(1, 3_000):
        assert S.length_partition(n) - S.length_partition(int(np.ceil(0.75 * n))) in (0, 1)


def test_edited_texts_follow_descending_ids(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 40, random_text(rng, rng.randrange(0, 60))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").repartition(5)
    got = {r["doc_id"]: r for r in S.edited_fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [brute_signatures(x) for x in (t, edited, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[i]["near_edited"] == pytest.approx(like(sets[0], sets[1]))
        assert got[i]["near_next"] == pytest.approx(like(sets[0], sets[2]))


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(8):
        base = random_text(rng, 150).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = "zz"
            rows.append((n, " ".join(copy)))
            n += 1
    sets = dict(zip([i for i, _ in rows], S.signature_sets(pa.array([t for _, t in rows]), S.anchor_hashes()), strict=True))
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if S.pruned_jaccard(sets[a], sets[b]) >= 0.75:
                    low[a] = low[b] = min(low[a], low[b])
    got = {r["doc_id"]: r["group_id"] for r in S.spot_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == low


def test_awkward_rows(awkward, nothing):
    rows = S.edited_fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == ""
    assert by[2]["n_chars"] == 0 and by[1]["fingerprint"] == by[6]["fingerprint"] != ""
    assert by[4]["near_next"] == 1.0 and by[2]["near_next"] == 0.0  # two empty ones; an empty one and another
    assert S.edited_fingerprints(nothing).count() == 0
    assert {r["doc_id"]: r["group_id"] for r in S.spot_groups(awkward).collect()}[6] == 1
    assert S.spot_groups(nothing).count() == 0


def test_one_row_follows_itself(spark):
    r = S.edited_fingerprints(spark.createDataFrame([(5, "abcdef", 1)], "doc_id long, text string, fingerprint int")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0

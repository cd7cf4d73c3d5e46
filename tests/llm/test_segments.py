import math
from collections import Counter

import numpy as np
import pytest

from orbitloom.llm import segment_sampling as S


@pytest.fixture(scope="module")
def voc():
    return S.vocabulary(S.MODEL)


def brute_segmentations(text, voc):
    """All ways to write " " + text in pieces, with their normalised probabilities."""
    by_text = {p.replace("▁", " "): i for i, p in enumerate(voc.pieces) if np.isfinite(voc.weight[i])}
    text = " " + text

    def ways(at):
        if at == len(text):
            return [((), 0.0)]
        out = []
        for to in range(at + 1, min(len(text), at + voc.longest) + 1):
            if text[at:to] in by_text:
                i = by_text[text[at:to]]
                out += [((i, *rest), w + voc.weight[i]) for rest, w in ways(to)]
        return out

    found = ways(0)
    total = sum(math.exp(w) for _, w in found)
    return {ids: math.exp(w) / total for ids, w in found}


def draws(text, n, k, voc):
    return list(S.sample_group([text] * n, np.arange(n, dtype=np.uint64), k, voc))


def test_probabilities_are_those_of_all_segmentations(voc):
    truth = brute_segmentations("abcd of", voc)
    for samples in draws("abcd of", 300, 3, voc):
        for ids, score, _ in samples:
            assert math.exp(score) == pytest.approx(truth[tuple(ids.tolist())])


def test_samples_are_distinct_and_follow_the_law_without_replacement(voc):
    truth = brute_segmentations("xy at", voc)
    n = 6_000
    out = draws("xy at", n, 2, voc)
    assert all(len({tuple(i.tolist()) for i, _, _ in s}) == len(s) == 2 for s in out)
    first = Counter(tuple(s[0][0].tolist()) for s in out)
    second = Counter(tuple(s[1][0].tolist()) for s in out)
    for ids, p in truth.items():
        q = sum(o * p / (1 - o) for i, o in truth.items() if i != ids)
        assert first[ids] / n == pytest.approx(p, abs=5 * math.sqrt(p / n) + 0.001)
        assert second[ids] / n == pytest.approx(q, abs=5 * math.sqrt(q / n) + 0.001)


def test_inclusion_scores_are_unbiased(voc):
    """The sum of p / inclusion over a sample has mean 1."""
    sums = [sum(math.exp(score - inclusion) for _, score, inclusion in s) for s in draws("hold on", 4_000, 3, voc)]
    assert np.mean(sums) == pytest.approx(1.0, abs=0.02)


def test_all_segmentations_of_a_small_text(voc):
    truth = brute_segmentations("ab", voc)
    [samples] = draws("ab", 1, 50, voc)
    assert {tuple(i.tolist()) for i, _, _ in samples} == set(truth) and samples[-1][2] == 0.0


def test_a_row_gets_the_same_samples_in_any_group(voc):
    texts = ["the first text", "another one here", "", "third"]
    keys = np.array([5, 6, 7, 8], np.uint64)
    together = list(S.sample_group(texts, keys, 3, voc))
    for k in range(4):
        [alone] = S.sample_group(texts[k:k + 1], keys[k:k + 1], 3, voc)
        assert [(i.tolist(), a, b) for i, a, b in alone] == [(i.tolist(), a, b) for i, a, b in together[k]]


@pytest.mark.parametrize("text", ["  two  spaces ", " ", "▁ mark ▁▁", "日本語 🚀 x\x00y\n\ttab", "é" * 20, "x" * 3_000, "<0x41> <s>"])
def test_round_trip(voc, text):
    for ids, _, _ in draws(text, 3, 2, voc)[0]:
        assert voc.decode(voc.ids(ids)) == text


def test_awkward_rows(awkward, nothing):
    rows = S.sample_segmentations(awkward.selectExpr("doc_id", "text", "1 AS ids")).collect()
    assert all(r["restored"] for r in rows)
    by = Counter(r["doc_id"] for r in rows)
    assert (by[2], by[3], by[1], by[6]) == (1, 1, 2, 4)
    assert {(r["n_pieces"], r["log_prob"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0.0)}
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    decoded = S.decode_segmentations(S.sample_segmentations(awkward)).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in decoded)
    assert S.sample_segmentations(nothing).count() == 0


RARE = ["ab cd " + "𓀀" * 30 + " of the", "𓀀" * 20, "龘靐齉爩" * 10, "日本語" * 40, "a𓀀b" * 20, "x" * 3_000, "plain text with incomprehensibilities"]


def test_characters_without_pieces_have_finite_scores_and_all_samples(voc):
    for text, many in ((t, S.sample_group([t], np.array([3], np.uint64), 2, voc)) for t in RARE):
        samples = next(iter(many))
        assert all(np.isfinite(score) and np.isfinite(inclusion) for _, score, inclusion in samples)
        assert len(samples) == (1 if text in RARE[1:4] else 2)  # these three can be written in one way only
        assert all(voc.decode(voc.ids(ids)) == text for ids, _, _ in samples)
    # the words beside the rare ones keep their choices
    assert len(next(iter(S.sample_group([RARE[0]], np.array([1], np.uint64), 2, voc)))) == 2


def test_a_row_is_the_same_alone_and_in_any_group(voc):
    texts = [*RARE, "the cat sat on the mat", "a b c d e f", "Grüße aus Köln", "w" * 500]
    keys = np.arange(len(texts), dtype=np.uint64)
    alone = [next(iter(S.sample_group([t], keys[i:i + 1], 3, voc))) for i, t in enumerate(texts)]
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], np.array([7, 0, 7, 1, 9])):
        for i, got in zip(order, S.sample_group([texts[i] for i in order], keys[order], 3, voc), strict=True):
            assert len(got) == len(alone[i])
            assert all((a[0] == b[0]).all() and a[1:] == b[1:] for a, b in zip(got, alone[i], strict=True))  # bit by bit


def test_ids_of_many_samples_are_those_of_each(voc):
    """Characters without a piece, of one and of several bytes, and samples without pieces."""
    rng = np.random.default_rng(5)
    bare = [10, 13, 0x80, 300, 0x4E2D, 0x1F600, S.MASKED]
    for _ in range(50):
        samples = [np.where(rng.random(n) < 0.4, -rng.choice(bare, n) - 1, rng.integers(300, 30_000, n)) for n in rng.integers(0, 9, rng.integers(1, 6))]
        each = [[x for p in s.tolist() for x in ([p] if p >= 0 else voc.encode_bytes(-p - 1))] for s in samples]
        ids, sizes = voc.ids_of_all(samples)
        assert sizes.tolist() == [len(x) for x in each] and ids.tolist() == [x for e in each for x in e]


def test_a_batch_is_taken_in_parts(voc):
    """Of a large batch of texts only some rows' output is held at a time, with the same rows as one by one."""
    texts = [f"text {i}\n" if i % 3 else None for i in range(2 * S.BATCH_ROWS + 7)]
    batch = S.pa.record_batch({"doc_id": S.pa.array(range(len(texts)), S.pa.int64()), "text": S.pa.array(texts, S.pa.string())})
    out = list(S._batches(S.MODEL, 2)(iter([batch])))
    assert len(out) >= 3 and all(len(set(b.column("doc_id").to_pylist())) <= S.BATCH_ROWS for b in out)
    alone = [r for i in (0, S.BATCH_ROWS, len(texts) - 1) for b in S._batches(S.MODEL, 2)(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r for r in rows if r["doc_id"] in (0, S.BATCH_ROWS, len(texts) - 1)] == alone and all(r["restored"] for r in rows)

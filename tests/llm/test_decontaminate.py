import random

import numpy as np
import pyarrow as pa
import pytest

from orbitloom.llm import decontaminate as D

VOCABULARY = [f"w{i}" for i in range(300)]


def plain_best(item, text):
    """Least edit distance of the item to any part of the text, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, words, rate):
    out = []
    for w in words:
        z = rng.random()
        if z < rate / 3:
            continue
        out.append(rng.choice(VOCABULARY) if z < 2 * rate / 3 else w)
        if z > 1 - rate / 3:
            out.append(rng.choice(VOCABULARY))
    return out


def test_best_place_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(5, 12))]
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 30))]
        want = plain_best(item, text)
        got = D.best_place(np.array(item, np.uint64), np.array(text, np.uint64), 100)
        assert got[0] == want
        assert D.best_place(np.array(item, np.uint64), np.array(text, np.uint64), want - 1) is None
        edits, a, b = got
        assert plain_best(item, text[a:b]) == want


def test_recall_against_brute_force():
    """Every passage whose edit distance allows it, at up to a tenth of edited words: recall at least 0.9."""
    rng = random.Random(2)
    items = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(12, 70))) for _ in range(40)]
    index = D.build_index(list(range(40)), items)
    texts, want = [], set()
    for n, item in enumerate(items * 3):
        body = edited(rng, item.split(), 0.1 if n >= 40 else 0.0)
        text = " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 90)) + body + rng.choices(VOCABULARY, k=40))
        texts.append(text)
        if plain_best(item.split(), text.split()) <= int(D.MAX_EDITS * len(item.split())):
            want.add((n, n % 40))
    got = {(row, item) for row, item, *_ in D.find_in(index, pa.array(texts))}
    assert {(n, n) for n in range(40)} <= got  # exact ones are always found
    assert got <= want  # nothing unconfirmed
    assert len(got & want) >= 0.9 * len(want)


def test_long_items_with_many_edits_are_found():
    rng = random.Random(8)
    items = [rng.choices([f"w{i}" for i in range(3_000)], k=200) for _ in range(40)]
    index = D.build_index(list(range(40)), [" ".join(x) for x in items])
    texts = [rng.choices(VOCABULARY, k=50) + edited(rng, x, 0.15) + rng.choices(VOCABULARY, k=50) for x in items]
    want = {(n, n) for n, (x, t) in enumerate(zip(items, texts)) if plain_best(x, t) <= int(D.MAX_EDITS * len(x))}
    assert len(want) >= 30
    assert {(row, item) for row, item, *_ in D.find_in(index, pa.array([" ".join(t) for t in texts]))} == want


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, D.MAX_EDITS])
@pytest.mark.parametrize("length", [12, 30, 59, 120, 300])
def test_recall_of_near_copies_by_length_and_edits(length, rate):
    """Near copies alone: as many edited words as the rate allows, at least one, none of them exact."""
    rng = random.Random(length)
    words = [f"w{i}" for i in range(3_000)]
    items = [rng.choices(words, k=length) for _ in range(30)]
    texts = []
    for item in items:
        parts = [[w] for w in item]
        for i in rng.sample(range(length), max(1, int(rate * length))):
            parts[i] = rng.choice(([], [f"new{i}"], [item[i], f"new{i}"]))
        texts.append(" ".join(rng.choices(words, k=rng.randrange(60)) + sum(parts, []) + rng.choices(words, k=40)))
    index = D.build_index(list(range(30)), [" ".join(x) for x in items])
    assert {(row, item) for row, item, *_ in D.find_in(index, pa.array(texts))} == {(n, n) for n in range(30)}


def test_a_passage_without_its_first_words_at_the_start_of_a_text():
    rng = random.Random(6)
    item = rng.choices(VOCABULARY, k=40)
    index = D.build_index([7], [" ".join(item)])
    texts = ["other text before it", " ".join(item[3:]), " ".join(item[2:]) + " and more", " ".join(rng.choices(VOCABULARY, k=30) + item[:-4])]
    assert {row for row, *_ in D.find_in(index, pa.array(texts))} == {1, 2, 3}


def test_clean_texts_stay():
    rng = random.Random(3)
    index = D.build_index([1], [" ".join(rng.choices(VOCABULARY, k=40))])
    texts = [" ".join(rng.choices(VOCABULARY, k=300)) for _ in range(200)]
    assert not list(D.find_in(index, pa.array(texts)))


def test_places_case_and_punctuation():
    item = "Élan vital one two three four five six seven eight"
    text = "🚀 before. ÉLAN, vital (one) two three Four five six: seven eight! after"
    [(row, i, a, b, edits)] = list(D.find_in(D.build_index([9], [item]), pa.array([text])))
    assert (row, i, edits) == (0, 9, 0) and text[a:b] == "ÉLAN, vital (one) two three Four five six: seven eight"


def test_short_items_and_long_words():
    item = "alpha beta gamma delta epsilon"
    index = D.build_index([1, 2], [item, "too short"])
    assert index.ids == [1, 2]
    got = list(D.find_in(index, pa.array([f"x {'y' * 700_000} {item} z", "it is Too short!", None, "", "too very short"])))
    assert [(r, i) for r, i, *_ in got] == [(0, 1), (1, 2)] and got[1][2:] == (6, 15, 0)


def test_short_items_match_their_exact_words_only():
    rng = random.Random(9)
    items = [" ".join(f"s{rng.randrange(4)}" for _ in range(n)) for n in (1, 2, 2, 3, 4, 4)]
    texts = [" ".join(f"s{rng.randrange(6)}" for _ in range(rng.randrange(9))) for _ in range(200)]
    got = {(row, item) for row, item, *_ in D.find_in(D.build_index(list(range(6)), items), pa.array(texts))}
    assert got == {(r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if f" {x} " in f" {t} "}


@pytest.mark.parametrize("item,copy", [
    ("床前明月光疑是地上霜举头望明月低头思故乡", "床前明月光,疑是地上霜。举头看明月,低头思故乡"),
    ("吾輩は猫である。名前はまだ無い。", "吾輩は猫である、名前はまだ無い"),
    ("สวัสดีครับยินดีต้อนรับ", "สวัสดีครับยินดีต้อนรับ"),
    ("𠀀𠀁𠀂𠀃𠀄𠀅", "𠀀𠀁𠀂𠀃𠀄𠀅"),
    ("un\u00a0deux\u2003trois\u200bquatre«cinq»six", "un deux trois quatre – cinq – six"),
])
def test_scripts_and_separators_beyond_ascii(item, copy):
    index = D.build_index([4], [item])
    texts = ["某" * 30, f"前文🚀 {copy} 後文", copy, "ein Satz – „ohne“ sie", ""]
    found = {row: text[a:b] for row, _, a, b, _ in D.find_in(index, pa.array(texts)) for text in [texts[row]]}
    assert found.keys() == {1, 2} and found[1] == found[2] == copy.rstrip("。")


def test_blocks_cover_all_items(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=20))) for i in range(7)] + [(99, None), (98, "short")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in items if t] + [(50, "clean text here")], "doc_id long, text string")
    monkeypatch.setattr(D, "BLOCK_ITEMS", 3)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_passages(docs, benchmark).collect()} == {(i, i) for i in [*range(7), 98]}
    assert {r["doc_id"] for r in D.drop_contaminated(docs, benchmark).collect()} == {50}


def test_awkward_rows(spark, awkward, nothing):
    benchmark = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran to a house", "x")], "item_id long, text string, doc_id string")
    got = sorted(r["doc_id"] for r in D.find_passages(awkward, benchmark).collect())
    assert got == [1, 6, 6]
    kept = D.drop_contaminated(awkward.selectExpr("doc_id", "text", "1 AS item_id"), benchmark)
    assert kept.columns == ["doc_id", "text", "item_id"] and kept.count() == awkward.count() - 3
    assert D.find_passages(nothing, benchmark).count() == 0
    assert D.find_passages(awkward, benchmark.limit(0)).count() == 0
    assert D.drop_contaminated(awkward, benchmark.limit(0)).count() == awkward.count()

"""Dictionary matching against plain loops."""

from __future__ import annotations

import random
import re

from orbitloom import vocab
from orbitloom.functions.querytext import region_name
from orbitloom.operators import dictionary as D

ALPHABET = "ab c_-."


def _random_words(r, n, low, high):
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(low, high))) for _ in range(n)]


def _frames(spark, texts, entries):
    return spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(e,) for e in entries], "e string")


def test_anywhere_equals_brute_force(spark):
    r = random.Random(3)
    texts, entries = _random_words(r, 60, 0, 40) + [None, "", "ab", "ab"], _random_words(r, 80, 1, 9) + [None, "", "a", "a"]
    t, e = _frames(spark, texts, entries)
    got = [tuple(x) for x in D.found_entries(t, "t", e, "e").collect()]
    want = {(a, b) for a in texts for b in entries if a and b and b in a}
    assert len(got) == len(set(got)) and set(got) == want


def test_whole_words_equal_patterns(spark):
    r = random.Random(4)
    texts = _random_words(r, 60, 0, 40)
    entries = [w for w in _random_words(r, 120, 1, 9) if re.match(r"\w", w, re.A) and re.search(r"\w$", w, re.A)]
    t, e = _frames(spark, texts, entries)
    got = {tuple(x) for x in D.found_entries(t, "t", e, "e", whole_words=True).collect()}
    assert got == {(a, b) for a in texts for b in entries if re.search(rf"\b{re.escape(b)}\b", a, re.A)}


def test_pattern_characters_are_plain(spark):
    t, e = _frames(spark, ["a.b (c) [d] \\E x", "axb"], ["a.b", "(c)", "\\E", "[d]", ".*"])
    assert {tuple(x) for x in D.found_entries(t, "t", e, "e").collect()} == {(t0, x) for t0 in ["a.b (c) [d] \\E x"] for x in ["a.b", "(c)", "\\E", "[d]"]}


def test_first_region_as_by_patterns(spark):
    names = [x[0] for x in vocab.REGIONS]
    texts = [f"show {a} and {b}" for a in names[:6] for b in names[-6:]] + [f"near{names[0]}", "nothing here", f"{names[3]}-{names[1]}", None]
    t = spark.createDataFrame([(x,) for x in texts], "low string")
    regions = spark.createDataFrame(list(zip(names, range(len(names)))), "name string, place int")
    got = D.first_entry(t, "low", regions, "name", "place").select("low", "entry")
    want = t.select("low", region_name("low").alias("entry"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hundred_thousand_names(spark):
    """Names that share their beginnings and endings; each text is one name in a sentence, a third of the texts are equal."""
    names = spark.range(100_000).selectExpr("concat('lake ', lower(hex(xxhash64(id))), ' district') AS e", "id")
    texts = names.where("id % 1000 = 7").selectExpr("concat('show ', e, ' in summer') AS t", "e AS own")
    many = texts.unionByName(texts.limit(1).crossJoin(spark.range(50)).select("t", "own"))
    got = D.found_entries(many, "t", names, "e", whole_words=True)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in texts.collect()}


def test_anchors_avoid_shared_pieces(spark):
    names = spark.range(2000).selectExpr("concat('lake ', lower(hex(xxhash64(id))), ' district') AS form")
    most = D.anchored(names).groupBy("anchor").count().selectExpr("max(count)").first()[0]
    assert most <= 2


def test_empty_tables(spark):
    t, e = _frames(spark, ["abc"], ["b"])
    assert D.found_entries(t.where("false"), "t", e, "e").count() == 0
    assert D.found_entries(t, "t", e.where("false"), "e").count() == 0
    assert D.first_entry(t, "t", e.where("false").selectExpr("e", "1 AS o"), "e", "o").collect()[0]["entry"] is None


def test_a_text_meets_all_its_entries_in_one_row(spark):
    from orbitloom.operators.dictionary import held_entries

    texts = spark.createDataFrame([("river delta in assam",), ("river delta in assam",), ("nothing",), (None,)], "low string")
    words = spark.createDataFrame([("river",), ("delta",), ("in",), ("assam",), ("as",), ("deltas",), ("",), (None,)], "word string")
    rows = held_entries(texts, "low", words, "word").collect()
    assert {r["text"]: sorted(r["entries"]) for r in rows} == {"river delta in assam": ["as", "assam", "delta", "in", "river"], "nothing": ["in"]}
    assert len(rows) == 2
    assert held_entries(texts, "low", words.limit(0), "word").collect() == []

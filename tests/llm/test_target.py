"""Importance resampling against the contract's words, written out feature by feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from orbitloom.llm import target_sampling as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets(text):
    w = words(text)
    return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(docs, target):
    """{position: (n_features, weight, score, rank)}; rows with equal score and id share the ranks they hold together."""
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10_000.0) / ((s[b] + 1.0) * (tt + 10_000.0))))
    rows = []
    for i, x in docs:
        own = buckets(x)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((k for k, (_, x) in enumerate(docs) if len(words(x)) >= 20), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(fit[:25 * len(fit) // 100], 1):
        rows[k][4] = rank
    return sorted(map(str, map(tuple, rows)))


def test_joined_checksums():
    rng = random.Random(2)
    texts = [rng.randbytes(rng.choice([1, 2, 3, 7, 64, 1000, 70_000])) for _ in range(60)]
    crc = np.array([zlib.crc32(x) for x in texts], np.uint32)
    size = np.array([len(x) for x in texts])
    got = T.joined_crc(crc[:-1], crc[1:], size[1:])
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(texts, texts[1:])]


def test_features_of_any_text():
    texts = ["The CAT, the cat!  the-cat", "", None, "x", "Ünï ünï É é", "a\x01b\x7fc d", "w" * 5_000 + " " + "w" * 300 + " w", "日本 語", " ,. "]
    data, offsets = T.column_bytes(pa.array(texts))
    bucket, row, n_words = T.features(data, offsets)
    assert n_words.tolist() == [len(words(x)) for x in texts]
    for i, x in enumerate(texts):
        assert sorted(bucket[row == i].tolist()) == sorted(buckets(x))


def test_rows_are_those_of_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary[:rng.choice([20, 100, 300])]) for _ in range(rng.randrange(60)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "é É " * 30), (5, docs[5][1]), (5, docs[5][1])]
    target = [" ".join(rng.choice(vocabulary[:30]) for _ in range(40)) for _ in range(20)] + [None, ""]
    got = T.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got.collect()) == brute(docs, target)


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    target = spark.createDataFrame([("the cat sat",)], "text string")
    extra = awkward.selectExpr("*", "1 AS n_words", "2 AS score", "3 AS rank", "4 AS own", "5 AS part", "6 AS place")
    got = sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in T.resample(extra, target).collect())
    assert got == brute(docs, ["the cat sat"])
    assert T.resample(nothing, target).collect() == []
    assert len(T.resample(awkward, nothing.select("text")).collect()) == len(docs)


def test_a_third_of_the_rows_under_one_id(spark):
    """Ranks run on within one id that holds a third of all rows, over several ranges."""
    docs = [(7, "w " * 25)] * 200 + [(i, f"w{i} " * 25) for i in range(100, 500)]
    got = T.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w w",)], "text string")).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 151))
    assert all(r.doc_id == 7 for r in got if r["rank"] and r["rank"] <= 100) == (min(r.score for r in got if r.doc_id == 7) > max(r.score for r in got if r.doc_id != 7))

"""Importance resampling towards a target distribution of hashed word features.

Features are the runs of one and two consecutive words; a feature's bucket is the crc32 of its bytes modulo `BUCKETS`.
The distinct words of a group of texts form an Aho-Corasick dictionary; an entry is a word between two delimiters and
carries the word's crc32, that of the word and a space, and its length.  One scan of the automaton over the group emits
the payloads in order; a pair's crc32 comes from the payloads of its words (the first one's, moved on by the length
of the second, xor the second one's), so no feature is spelled out or hashed by its bytes.

The scan runs twice: it counts the buckets of corpus and target, and it scores each document by the mean gain of its
features (how much likelier a bucket is in the target).  Counts are added up per task before the shuffle; only the
table of `BUCKETS` gains goes to the driver and to the tasks.  A Gumbel number from the document's id makes the highest
scores a sample without replacement, with probabilities by weight; ranks come from a distributed sort.

Defined results: words are runs of letters and digits, A-Z as a-z, every character beyond ASCII counts as a letter; a
null or empty text has no features, weight 0 and can't be drawn; a row without an id takes part with an empty id in its
random number, and counts as the largest id in ties; repeated rows have equal scores and each its own rank; with no
documents there are no rows, with no target texts all buckets are equally unlikely there; words and texts of any length are
whole (words over `LONG_WORD` characters stand in the dictionary under a short name); other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .words import column_bytes, row_groups

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 7, 20, 25
GROUP_BYTES = 2 << 20
LONG_WORD = 256
ROW_END = "\x01"  # a word that no text holds: \x01 is a delimiter

_fold = np.full(256, 0x20, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _fold[_first:_last + 1] = np.arange(_first, _last + 1)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD = _fold.tobytes()  # A-Z to a-z, delimiters to spaces


def _one_byte() -> np.ndarray:
    """What a zero byte behind a text does to its crc32: an operator, as the images of the four bytes' values."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    values = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    return table[values & 0xFF] ^ values >> np.uint32(8)


def _applied(operator: np.ndarray, x: np.ndarray) -> np.ndarray:
    return operator[0, x & 0xFF] ^ operator[1, x >> 8 & 0xFF] ^ operator[2, x >> 16 & 0xFF] ^ operator[3, x >> 24]


SHIFTS = [_one_byte()]  # by 1, 2, 4, ... bytes
for _ in range(31):
    SHIFTS.append(_applied(SHIFTS[-1], SHIFTS[-1]))


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two texts, one behind the other, from theirs and the bytes of the second one."""
    out = first.copy()
    for j in range(int(size.max(initial=0)).bit_length()):
        on = np.flatnonzero(size >> j & 1)
        out[on] = _applied(SHIFTS[j], out[on])
    return out ^ second


class Dictionary:
    """Automaton and payloads of a group's distinct words; number 0 is the end of a row."""

    def __init__(self, words: list[str]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.automaton.add_word(f" {ROW_END} ", 0)
        self.names: dict[str, str] = {}
        spelled = [w.encode() for w in words]
        for i, w in enumerate(words, 1):
            if len(w) > LONG_WORD:
                self.names[w] = f"{ROW_END}{i}"
                w = self.names[w]
            self.automaton.add_word(f" {w} ", i)
        self.automaton.make_automaton()
        self.crc = np.array([0, *map(crc32, spelled)], np.uint32)
        self.crc_and_space = np.array([0, *(crc32(b" ", int(c)) for c in self.crc[1:])], np.uint32)
        self.size = np.array([0, *map(len, spelled)], np.int64)

    def scan(self, text: str) -> np.ndarray:
        """Numbers of the words of `text` (single words between spaces, a space at both ends) in order."""
        if self.names:
            text = " ".join(self.names.get(w, w) for w in text.split(" "))
        return np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of all features of the rows, and the rows' numbers of words."""
    folded = data.tobytes().translate(FOLD)
    end = f" {ROW_END} ".encode()
    text = (b" " + end.join(folded[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)) + end).decode()
    words = set(text.split(" "))
    words -= {"", ROW_END}
    held = Dictionary(sorted(words))
    number = held.scan(text)
    row = np.cumsum(number == 0) - (number == 0)
    single = number > 0
    pair = np.flatnonzero(single[:-1] & single[1:])
    left, right = number[pair], number[pair + 1]
    crc = np.concatenate((held.crc[number[single]], joined_crc(held.crc_and_space[left], held.crc[right], held.size[right])))
    rows = len(offsets) - 1
    return crc.astype(np.int64) % BUCKETS, np.concatenate((row[single], row[pair])), np.bincount(row[single], minlength=rows)


def groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(texts)
    for lo, hi in row_groups(offsets, GROUP_BYTES):
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts per bucket; a task sends one row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in groups(batch.column(0)):
                total += np.bincount(features(data, offsets)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in `target` than in `docs`, both with one more in each bucket."""
    both = bucket_counts(docs).withColumn("side", F.lit(0)).unionByName(bucket_counts(target).withColumn("side", F.lit(1)))
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in both.collect():  # at most BUCKETS rows a side
        counts[r["side"], r["bucket"]] = r["n"]
    total = counts.sum(axis=1) + BUCKETS
    s, t = counts + 1
    return np.array([math.floor(1000 * math.log(float(b) * float(total[0]) / (float(a) * float(total[1])))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of every row's features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in groups(batch.column(1)):
                bucket, row, n_words = features(data, offsets)
                gain = np.zeros(hi - lo, np.int64)
                np.add.at(gain, row, gains[bucket])
                n = n_words + np.maximum(n_words - 1, 0)
                yield pa.record_batch([
                    batch.column(0).slice(lo, hi - lo), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                    pa.array(gain // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds `score`: the weight plus 1000 times a Gumbel number from the row's id, floored."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighted.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long"))


def with_ranks(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds `rank` to the drawn rows: 1, 2, ... by falling score, then id.

    The rows are sorted over ranges of the order and written; a row's rank is its place in its range behind the sizes
    of the ranges before, of which there are as many as tasks.  No range is cut by key alone: equal rows are told apart
    by a number of their own, so any of them can be split.
    """
    eligible = F.col("n_words") >= min_words
    order = [eligible.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("own")]
    spark = scored.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = materialize(sorted_.drop("own").withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"], r["fit"]) for r in placed.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.count(F.when(eligible, 1)).alias("fit")).collect())  # one row per range
    drawn = percent * sum(fit for _, _, fit in sizes) // 100
    before, rows = 0, []
    for number, n, _ in sizes:
        rows.append((number, before))
        before += n
    starts = spark.createDataFrame(rows, "part long, before long")
    rank = F.col("before") + (F.col("place") - F.shiftleft(part, 33)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part", "left")
    return ranked.withColumn("rank", F.when(eligible & (rank <= drawn), rank)).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of `docs` (doc_id, text); `rank` is null for rows that
    aren't drawn.  `target` holds the texts of the wanted distribution."""
    scored = materialize(with_scores(weights(docs, bucket_gains(docs, target)), seed), "scored")
    return with_ranks(scored, percent, min_words)

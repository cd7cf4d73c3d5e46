"""Cumulative-link ordinal regression on sparse hashed text features.

P(grade >= j) = sigmoid(w . x - t_j) with one weight vector w for all thresholds t_1 < t_2 < ...  Features are hashed
into `BUCKETS`; the buckets that tell grades apart (likelihood ratio over the labelled sample) enter the model.  Texts
are read whole, as byte arrays; Spark counts features and scores documents, and the driver only fits a bounded matrix:
at most `sample` rows by `selected` columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import PUNCTUATION, SPACES, VALUES, column_bytes, mix, row_groups, tokenize, tokenize_prefixes

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8, 10)
L2 = 0.01
MIN_RATIO = 12.0  # likelihood ratio of a feature that enters: chance reaches it in one of 2,000

# letters of one kind have one value, so that the hash of a token is that of its outline; other bytes keep their own
OUTLINE = VALUES.copy()
OUTLINE[0x41:0x5B], OUTLINE[0x61:0x7B], OUTLINE[0x30:0x3A], OUTLINE[0x80:] = VALUES[0x80], VALUES[0x81], VALUES[0x82], VALUES[0x81]


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(46)).astype(np.int64)


def _rows(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and their beginnings, A-Z as a-z: (row, bucket) of every occurrence, and the words per row.  A beginning
    that a text has twice, or three times and more, is a feature of its own as well."""
    hashes, _, _, starts = tokenize_prefixes(data, offsets, PUNCTUATION, (None, *PREFIXES))
    rows = _rows(starts)
    all_rows, buckets = [rows], [_bucket(hashes[0], 1)]
    for p, h in zip(PREFIXES, hashes[1:], strict=True):
        b = _bucket(h, 1 + p)
        r, own, count = _pairs(rows, b)
        all_rows += [rows, r[count == 2], r[count > 2]]
        buckets += [b, _bucket(own[count == 2].astype(np.uint64), 40), _bucket(own[count > 2].astype(np.uint64), 41)]
    return np.concatenate(all_rows), np.concatenate(buckets), np.diff(starts)


def form_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the outlines of tokens' last three bytes and of whole short tokens, words said twice in a row, and one
    bucket for the share of different words at the text's length."""
    h, first, end, starts = tokenize(data, offsets, SPACES)
    rows, n = _rows(starts), np.diff(starts)
    tail = np.zeros(len(h), np.uint64)
    for back in (3, 2, 1):
        at = end - back
        tail = tail * np.uint64(1099511628211) + np.where(at >= first, OUTLINE[data[np.maximum(at, 0)]], np.uint64(0))
    again = np.flatnonzero((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) + 1
    words, _, _, word_starts = tokenize(data, offsets, PUNCTUATION)
    order = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    different = np.bincount(rows[order][new], minlength=len(n))
    some = np.flatnonzero(n)
    share = (np.minimum(19, 20 * different[some] // n[some]) + 32 * np.log2(n[some]).astype(np.int64)).astype(np.uint64)
    return (
        np.concatenate((rows, rows[again], _rows(word_starts), some)),
        np.concatenate((_bucket(mix(tail), 20), _bucket(np.zeros(len(again), np.uint64), 21), _bucket(words, 1), _bucket(share, 22))), n)


KINDS = {"words": word_features, "form": form_features}


def _counted(column: pa.Array, kind: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of rows: first row, end row, then row, bucket and count of each feature, and the tokens per row."""
    data, offsets = column_bytes(column)
    for lo, hi in row_groups(offsets, 1 << 20):
        own = offsets[lo:hi + 1] - offsets[lo]
        rows, buckets, n = KINDS[kind](data[offsets[lo]:offsets[hi]], own)
        yield lo, hi, rows, buckets, n


def _pairs(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts


def bucket_counts(kind: str, grades: int):
    """Documents per bucket and grade, and occurrences in grade 0, summed within a task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((grades + 1, BUCKETS), np.int64)
        for batch in batches:
            y = batch.column("grade").to_numpy(zero_copy_only=False)
            for lo, _, rows, buckets, _ in _counted(batch.column("text"), kind):
                r, b, c = _pairs(rows, buckets)
                np.add.at(seen, (y[lo + r], b), 1)
                lowest = y[lo + r] == 0
                np.add.at(seen, (grades, b[lowest]), c[lowest])
        used = np.flatnonzero(seen[:grades].sum(0) > 0)
        for at in range(0, len(used), 50_000):
            part = used[at:at + 50_000]
            yield pa.record_batch([pa.array(part), *[pa.array(x) for x in seen[:, part]]], names=["bucket", *[f"g{g}" for g in range(grades)], "times"])
    return run


def feature_rows(kind: str, chosen: np.ndarray):
    """Per document its chosen features: indices, counts, tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(BUCKETS, -1, np.int64)
        index[chosen] = np.arange(len(chosen))
        for batch in batches:
            ids, counts, tokens = [], [], []
            for lo, hi, rows, buckets, n in _counted(batch.column("text"), kind):
                hit = index[buckets] >= 0
                r, b, c = _pairs(rows[hit], buckets[hit])
                cuts = np.searchsorted(r, np.arange(1, hi - lo))
                ids += np.split(index[b], cuts)
                counts += np.split(c, cuts)
                tokens += n.tolist()
            yield pa.record_batch([
                batch.column("grade"), pa.array([i.tolist() for i in ids], pa.list_(pa.int64())),
                pa.array([c.tolist() for c in counts], pa.list_(pa.int64())), pa.array(tokens, pa.int64())], names=["grade", "ids", "counts", "tokens"])
    return run


def likelihood_ratio(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """2 x log likelihood ratio of "a bucket's presence depends on the grade", per bucket (grades x buckets)."""
    n, total = sizes.sum(), counts.sum(0)
    out = np.zeros(counts.shape[1])
    for seen, base in ((counts, total), (sizes[:, None] - counts, n - total)):
        expected = sizes[:, None] * base / n
        with np.errstate(divide="ignore", invalid="ignore"):
            out += 2 * np.where(seen > 0, seen * np.log(seen / expected), 0).sum(0)
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """`rates`: occurrences per token in grade 0.  A feature's value is the root of the Poisson deviance of its count
    above that rate, so that a count means less in a long text; without rates, the logarithm of its density."""

    kind: str
    chosen: np.ndarray
    rates: np.ndarray | None
    weights: np.ndarray
    thresholds: np.ndarray

    def value(self, cols: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        if self.rates is None:
            return np.log1p(100 * counts / np.maximum(tokens, 1))
        expected = self.rates[cols] * tokens + 1e-4
        return np.sqrt(2 * np.where(counts > expected, counts * np.log(counts / expected) - (counts - expected), 0))

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... (documents x thresholds)."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds, -40, 40)))

    def latent(self, column: pa.Array) -> np.ndarray:
        index = np.full(BUCKETS, -1, np.int64)
        index[self.chosen] = np.arange(len(self.chosen))
        out = np.zeros(len(column))
        for lo, hi, rows, buckets, n in _counted(column, self.kind):
            hit = index[buckets] >= 0
            r, b, c = _pairs(rows[hit], buckets[hit])
            out[lo:hi] = np.bincount(r, self.weights[index[b]] * self.value(index[b], c, n[r]), minlength=hi - lo)
        return out


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, grades: int, l2: float = L2, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the mean negative log likelihood (thresholds as a first one and
    positive gaps)."""
    n = len(y)
    w = np.zeros(width)
    share = np.clip(np.array([(y >= j).mean() for j in range(1, grades)]), 1e-3, 1 - 1e-3)
    t = np.sort(np.log((1 - share) / share))
    gaps = np.log(np.maximum(np.diff(t), 1e-2))
    theta = np.concatenate((w, t[:1], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, first, widths = theta[:width], theta[width], np.exp(np.clip(theta[width + 1:], -20, 20))
        t = first + np.concatenate(([0.0], np.cumsum(widths)))
        z = np.bincount(rows, vals * w[cols], minlength=n)
        upper = np.concatenate((t, [np.inf]))[y]  # grade y lies between thresholds y and y + 1
        lower = np.concatenate(([-np.inf], t))[y]
        a, b = np.where(np.isinf(lower), 1.0, sig(z - lower)), np.where(np.isinf(upper), 0.0, sig(z - upper))
        p = np.maximum(a - b, 1e-12)
        da, db = np.where(np.isinf(lower), 0, a * (1 - a)) / p, np.where(np.isinf(upper), 0, b * (1 - b)) / p
        dz = -(da - db) / n
        dt = np.zeros(grades - 1)
        np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, da, 0) / n)
        np.add.at(dt, np.minimum(y, grades - 2), np.where(y < grades - 1, -db, 0) / n)
        grad = np.concatenate((np.bincount(cols, vals * dz[rows], minlength=width) + l2 * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * widths))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    widths = np.exp(np.clip(theta[width + 1:], -20, 20))
    return theta[:width], theta[width] + np.concatenate(([0.0], np.cumsum(widths)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled documents (the smallest hashes of doc_id), each text once per grade column set.

    The sample's ids and labels are broadcast: `sample` rows at most.  A document with several labels has the last of
    its (quality, toxic); rows without an id or a label do not count.
    """
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    rated = rated.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("quality", "toxic")).alias("l"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return (
        texts.join(F.broadcast(rated), "doc_id").select("doc_id", "text", "l.quality", "l.toxic")
        .dropDuplicates(["text", "quality", "toxic"])
    )


def fit(graded: DataFrame, grades: int, kind: str, surprise: bool, selected: int = 2048, regrade=None) -> OrdinalModel:
    """Fits on `graded` (grade int, text), a bounded sample.  `regrade(grade, ids, counts, tokens, leaning)` may refine
    the grades; `leaning` is each chosen feature's log odds for the upper half of the first grades."""
    first = 2 if regrade else grades
    counted = graded.select("grade", "text").mapInArrow(bucket_counts(kind, first), "bucket long, " + ", ".join(f"g{g} long" for g in range(first)) + ", times long")
    sizes_by = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([sizes_by.get(g, 0) for g in range(first)], float)
    if (sizes > 0).sum() < 2:  # nothing to tell apart
        only = int(np.argmax(sizes)) if sizes.sum() else 0
        return OrdinalModel(kind, np.zeros(0, np.int64), None, np.zeros(0), np.where(np.arange(1, grades) <= only, -40.0, 40.0))
    table = counted.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in (*[f"g{g}" for g in range(first)], "times")]).toPandas()  # at most BUCKETS rows
    counts = table[[f"g{g}" for g in range(first)]].to_numpy(float).T
    ratio = likelihood_ratio(counts, sizes)
    best = np.lexsort((table["bucket"].to_numpy(), -ratio))[:selected]
    best = best[ratio[best] >= MIN_RATIO]
    chosen = table["bucket"].to_numpy()[best]
    half = max(1, first // 2)
    rate = lambda c, s: (c.sum(0) + 0.5) / (s.sum() + 1)
    leaning = np.log(rate(counts[half:, best], sizes[half:]) / rate(counts[:half, best], sizes[:half]))
    found = graded.select("grade", "text").mapInArrow(feature_rows(kind, chosen), "grade int, ids array<long>, counts array<long>, tokens long").toPandas()
    y = found["grade"].to_numpy(np.int64)
    lengths = found["ids"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(y)), lengths)
    cols = np.concatenate([*found["ids"], np.zeros(0)]).astype(np.int64)
    counts_ = np.concatenate([*found["counts"], np.zeros(0)])
    tokens = found["tokens"].to_numpy(float)
    rates = (table["times"].to_numpy(float)[best] + 0.5) / (tokens[y == 0].sum() + 1) if surprise else None
    if regrade:
        y = regrade(y, rows, cols, counts_, tokens, leaning)
    blank = OrdinalModel(kind, chosen, rates, np.zeros(len(chosen)), np.zeros(grades - 1))
    weights, thresholds = fit_cumulative(rows, cols, blank.value(cols, counts_, tokens[rows]), y, len(chosen), grades)
    return OrdinalModel(kind, chosen, rates, weights, thresholds)

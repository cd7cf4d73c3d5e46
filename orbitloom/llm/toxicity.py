"""Toxicity: severity grades by cumulative-link ordinal regression.

Grades: 0 for documents labelled clean; the labelled toxic ones are graded 1 to 3 by thirds of the share of their
words that lean to the toxic label.  All thresholds share the weights of hashed words and word beginnings (4 to 10
bytes, so that inflected forms of one stem count together).  Results: expected severity, the sum of P(grade >= j), and
P(grade >= 1); a document is rejected where the latter is 0.2 or more: most grades are 0, and the weights are shrunk.

Defined results: a null or empty text has no features and gets the base rates; labels that are null, or of unknown
documents, do not count; without labels of both kinds every document gets the one grade there is (0 without labels).
Repeated rows get equal results; other columns are ignored by `score` and kept by `drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordinal import OrdinalModel, fit, labelled_sample

GRADES, SAMPLE, SELECTED, CUTOFF = 4, 12_000, 512, 0.2


def severity_grades(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, tokens: np.ndarray, leaning: np.ndarray) -> np.ndarray:
    flagged = np.bincount(rows, counts * (leaning[cols] > 0), minlength=len(y)) / np.maximum(tokens, 1)
    toxic = y > 0
    out = np.zeros(len(y), np.int64)
    out[toxic] = 1 + np.searchsorted(np.quantile(flagged[toxic], [1 / 3, 2 / 3]), flagged[toxic], "left")
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    rated = labelled_sample(docs, labels, sample).select((F.col("toxic") > 0).cast("int").alias("grade"), "text")
    return fit(rated, GRADES, "words", surprise=True, selected=SELECTED, regrade=severity_grades)


def _score_batches(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(model.latent(batch.column("text")))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(np.round(tails.sum(1), 6)), pa.array(np.round(tails[:, 0], 6)),
                pa.array(tails[:, 0] >= CUTOFF)], names=["doc_id", "expected_severity", "p_toxic", "rejected"])
    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, rejected) of every row of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, expected_severity double, p_toxic double, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, that the model does not reject."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = model.tails(model.latent(batch.column(text)))[:, 0] < CUTOFF
            yield batch.filter(pa.array(stays))
    return docs.mapInArrow(run, docs.schema)

"""Quality: graded ratings by cumulative-link ordinal regression on hashed text.

Ratings: 0 for documents labelled as of low quality, 1 for good but toxic ones, 2 for the rest.  Features are hashed
words, token outlines, immediate repetitions and the share of different words, as densities.  Both thresholds share the
weights.  Results: expected grade, P(grade >= 1), P(grade >= 2); a document is selected where P(grade >= 1) is 0.5 or more.

Defined results: as for toxicity; a null or empty text has no features and gets the base rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordinal import OrdinalModel, fit, labelled_sample

GRADES, SAMPLE, CUTOFF = 3, 12_000, 0.5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2).cast("int")
    return fit(labelled_sample(docs, labels, sample).select(grade.alias("grade"), "text"), GRADES, "form", surprise=False)


def _score_batches(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(model.latent(batch.column("text")))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(np.round(tails.sum(1), 6)), pa.array(np.round(tails[:, 0], 6)),
                pa.array(np.round(tails[:, 1], 6)), pa.array(tails[:, 0] >= CUTOFF)],
                names=["doc_id", "expected_grade", "p_usable", "p_good", "selected"])
    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_grade, p_usable, p_good, selected) of every row of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, expected_grade double, p_usable double, p_good double, selected boolean")

"""Retrieval quality, paired-embedding recall and contrastive batch metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .knn import matrix
from .pruned import match_rank
from .ranking import one_row


def judged_hits(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Ranked hits (query_id, tile_id, rank) with a `relevant` flag from a judgment table."""
    good = judgments.where(F.col("relevant") == 1).select("query_id", "tile_id").distinct().withColumn("_good", F.lit(True))
    return hits.join(good, ["query_id", "tile_id"], "left").withColumn("relevant", F.coalesce("_good", F.lit(False))).drop("_good")


def per_query_metrics(judged: DataFrame, sizes: DataFrame, ks=(1, 5, 10), precision_at: int = 5) -> DataFrame:
    """Recall@K (capped by the number of relevant tiles), P@5, reciprocal rank and the top three per query.

    `sizes` is (query_id, relevant_count); queries without relevant tiles are left out, queries without
    hits score 0.  Only the top 3 ids are gathered, whatever the hit count.
    """
    rel, rank = F.col("relevant"), F.col("rank")
    agg = judged.groupBy("query_id").agg(
        *[F.count_if(rel & (rank <= k)).alias(f"_h{k}") for k in ks],
        F.count_if(rel & (rank <= precision_at)).alias("_p"), F.min(F.when(rel, rank)).alias("_first"), F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.when(rank <= 3, F.struct("rank", "tile_id")))).alias("_top"),
    )
    df = sizes.where(F.col("relevant_count") > 0).join(agg, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select(
        "query_id", "relevant_count", zero("_n").alias("total_retrieved"),
        *[(zero(f"_h{k}") / F.least(F.lit(k), F.col("relevant_count"))).alias(f"recall_{k}") for k in ks],
        (zero("_p") / F.lit(float(precision_at))).alias(f"precision_{precision_at}"),
        F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.array_join(F.transform("_top", lambda e: e["tile_id"]), ","), F.lit("")).alias("top_3"),
    )


def metric_means(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over queries, 4 decimals."""
    names = [c for c in metrics.columns if c.startswith(("recall_", "precision_"))]
    return metrics.agg(
        F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias("mean_" + c) for c in names],
        F.round(F.avg("reciprocal_rank"), 4).alias("mrr"),
    )


def paired_recall(images: DataFrame, texts: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Recall@K both ways and their mean on paired embeddings (tile_id, embedding) / (query_id, embedding).

    The rank of the matching item is counted, so no top-k list is kept.
    """
    rename = lambda df, a, b: df.select(F.col(a).alias(b), "embedding")
    t2i = match_rank(images, texts)
    i2t = match_rank(rename(texts, "query_id", "tile_id"), rename(images, "tile_id", "query_id"))

    def shares(ranks: DataFrame, tag: str) -> DataFrame:
        return ranks.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}_{tag}") for k in ks])

    both = one_row(shares(i2t, "i2t"), shares(t2i, "t2i"))
    return both.withColumns({f"recall_{k}": (F.col(f"recall_{k}_i2t") + F.col(f"recall_{k}_t2i")) / 2 for k in ks})


def contrastive_batches(pairs: DataFrame, temperature: float = 0.07, smoothing: float = 0.1, hard_weight: float = 1.0) -> DataFrame:
    """Per batch: symmetric smoothed cross-entropy and top-1 accuracy both ways.

    `pairs` is (batch, item, image, text).  A batch is one training batch, so its matrix is bounded by
    construction.  `hard_weight` multiplies the logit of each image's hardest wrong text.
    """
    def cross_entropy(logits: np.ndarray) -> float:
        top = logits.max(axis=1, keepdims=True)
        logp = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
        return float(-((1 - smoothing) * np.diag(logp) + smoothing * logp.mean(axis=1)).mean())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        logits = matrix(pdf["image"]) @ matrix(pdf["text"]).T / temperature
        n = len(pdf)
        own = np.arange(n)
        weighted = logits
        if hard_weight != 1.0 and n > 1:
            masked = logits.copy()
            masked[own, own] = -np.inf
            weighted = logits.copy()
            weighted[own, masked.argmax(axis=1)] *= hard_weight
        i2t, t2i = cross_entropy(weighted), cross_entropy(weighted.T)
        return pd.DataFrame({
            "batch": [pdf["batch"].iloc[0]], "items": [n], "loss_i2t": [i2t], "loss_t2i": [t2i], "loss": [(i2t + t2i) / 2],
            "accuracy_i2t": [float((logits.argmax(axis=1) == own).mean())], "accuracy_t2i": [float((logits.argmax(axis=0) == own).mean())],
        })

    schema = "batch long, items long, loss_i2t double, loss_t2i double, loss double, accuracy_i2t double, accuracy_t2i double"
    return pairs.select("batch", "item", "image", "text").groupBy("batch").applyInPandas(run, schema)


def pair_evaluation(analyses: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """Evaluation rows of analysed pairs; with latencies (analysis_id, latency_ms) also the mean latency."""
    rows = analyses.where(F.col("status") == "completed").select(
        "analysis_id", "t1_tile_id", "t2_tile_id", "t1_date", "t2_date", "change_type", F.col("final_score").alias("confidence"),
        "structural", "seasonal_confound", "cloud_contamination",
    )
    return rows if latencies is None else rows.join(latencies, "analysis_id", "left")

"""Prompt ensembles and batch encoding behind a pluggable encoder."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import vector as V


class Encoder(Protocol):
    """Anything that turns a list of texts into unit row vectors; it must pickle."""

    name: str
    version: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic signed feature hashing of lower-case words, L2-normalised; no words give a zero vector."""

    name = "hashing-words"
    version = "hashing-words-v1"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _slot(self, word: str) -> tuple[int, float]:
        digest = hashlib.md5(word.encode("utf-8")).hexdigest()
        return int(digest[:8], 16) % self.dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0

    def encode(self, texts: list[str]) -> np.ndarray:
        slots: dict[str, tuple[int, float]] = {}
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split(" "):
                if word:
                    if word not in slots:
                        slots[word] = self._slot(word)
                    at, sign = slots[word]
                    out[i, at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def prompts_of(text: Column) -> Column:
    """The prompt templates filled with a text; an empty text keeps one empty prompt."""
    filled = F.array(*[F.format_string(t, text) for t in vocab.PROMPT_TEMPLATES])
    return F.when(F.length(text) > 0, filled).otherwise(F.array(text))


def encode_texts(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = 1024) -> DataFrame:
    """Batch-encode a text column; one encoder per Python worker, whole texts, Arrow batches."""
    schema = f"{df.select(*[c for c in df.columns if c != out]).schema.toDDL()}, {out} array<float>"

    def run(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in encoder.encode(texts[at:at + batch])]
            yield pdf.assign(**{out: [v.astype(np.float32) for v in vectors]})

    return df.mapInPandas(run, schema)


def encode_prompts(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    """Ensemble vector of each text: all its prompts encoded, averaged and normalised."""
    staged = df.withColumn("_prompts", prompts_of(F.trim(F.col(text))))
    schema = staged.drop("_prompts").schema.toDDL() + ", _vectors array<array<double>>"

    def run(batches):
        for pdf in batches:
            flat = [p for ps in pdf["_prompts"] for p in ps]
            vectors = encoder.encode(flat)
            cuts = np.cumsum([len(ps) for ps in pdf["_prompts"]])[:-1]
            parts = [[list(v) for v in part] for part in np.split(vectors, cuts)] if len(flat) else []
            yield pdf.drop(columns="_prompts").assign(_vectors=pd.Series(parts, index=pdf.index, dtype=object))

    return staged.mapInPandas(run, schema).withColumn(out, V.ensemble(F.col("_vectors"))).drop("_vectors")

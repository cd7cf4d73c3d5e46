"""Opening, closing, connected regions and shift estimation, per pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DISK = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3) if dr * dr + dc * dc <= 4]
MIN_AREA = 50


def _spread(mask: DataFrame, pair: str) -> DataFrame:
    """Every mask pixel to its 13 disk positions, counted per position inside the image."""
    offsets = ", ".join(f"struct({dr} AS dr, {dc} AS dc)" for dr, dc in DISK)
    moved = mask.select(pair, "row", "col", "height", "width", F.expr(f"explode(array({offsets})) AS o")).selectExpr(
        pair, "row + o.dr AS row", "col + o.dc AS col", "height", "width"
    ).where("row >= 0 AND col >= 0 AND row < height AND col < width")
    return moved.groupBy(pair, "row", "col", "height", "width").agg(F.count("*").alias("hits"))


def dilate(mask: DataFrame, pair: str = "pair_id") -> DataFrame:
    return _spread(mask, pair).drop("hits")


def erode(mask: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Keep centers whose whole in-image neighbourhood is set; neighbours outside the image are ignored."""
    inside = " + ".join(f"int(row + {dr} >= 0 AND row + {dr} < height AND col + {dc} >= 0 AND col + {dc} < width)" for dr, dc in DISK)
    return _spread(mask, pair).where(f"hits = {inside}").drop("hits")


def clean(mask: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Opening then closing with a radius-2 disk.  Input and output hold mask pixels only:
    (pair, row, col, height, width)."""
    return erode(dilate(dilate(erode(mask, pair), pair), pair), pair)


def _label(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Region label (smallest member index) of each pixel under 8-neighbourhood, by min-propagation
    with pointer jumping over the pixel's neighbours."""
    n = len(rows)
    width = int(cols.max()) + 3
    code = (rows.astype(np.int64) + 1) * width + cols + 1
    order = np.argsort(code)
    sorted_code = code[order]
    links = []
    for step in (1, width - 1, width, width + 1):
        at = np.searchsorted(sorted_code, code + step)
        at_ok = at < n
        hit = np.zeros(n, dtype=bool)
        hit[at_ok] = sorted_code[at[at_ok]] == code[at_ok] + step
        links.append(np.stack([np.flatnonzero(hit), order[at[hit]]]))
    a, b = np.concatenate(links, axis=1)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def regions(mask: DataFrame, pair: str = "pair_id", pair_type: str = "string") -> DataFrame:
    """Mask pixels with `region` (row * 2^20 + col of its first pixel) and `area`.  A region never leaves its
    pair's image, so each group is at most one image."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        lab = _label(pdf["row"].to_numpy(), pdf["col"].to_numpy())
        area = np.bincount(lab, minlength=len(lab))[lab]
        return pdf[[pair, "row", "col"]].assign(
            region=pdf["row"].to_numpy("int64")[lab] * (1 << 20) + pdf["col"].to_numpy("int64")[lab], area=area.astype("int64"))

    schema = f"{pair} {pair_type}, row int, col int, region long, area long"
    return mask.select(pair, F.col("row").cast("int"), F.col("col").cast("int")).groupBy(pair).applyInPandas(run, schema)


def large_regions(labelled: DataFrame, min_area: int = MIN_AREA) -> DataFrame:
    return labelled.where(F.col("area") >= min_area)


def shift_estimates(pairs: DataFrame, pair: str = "pair_id", pair_type: str = "string") -> DataFrame:
    """Translation between both dates by phase correlation of gray images, per pair.

    Needs the whole image at once, hence Python; a pair is one image.  Missing pixels read as 0.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        gray = np.zeros((2, h, w))
        for i, name in enumerate(("g1", "g2")):
            gray[i, pdf["row"], pdf["col"]] = pdf[name]
        spec = np.fft.fft2(gray)
        cross = spec[0] * np.conj(spec[1])
        surface = np.fft.fftshift(np.abs(np.fft.ifft2(cross / (np.abs(cross) + 1e-12))))
        peak = np.unravel_index(np.argmax(np.round(surface, 9)), surface.shape)
        return pd.DataFrame({pair: [pdf[pair].iloc[0]], "shift_y": [float(peak[0] - h // 2)], "shift_x": [float(peak[1] - w // 2)]})

    gray = lambda s: (F.col("red" + s) + F.col("green" + s) + F.col("blue" + s)) / 3.0
    raw = pairs.select(pair, "row", "col", gray("1").alias("g1"), gray("2").alias("g2")).groupBy(pair).applyInPandas(
        run, f"{pair} {pair_type}, shift_y double, shift_x double"
    )
    total = F.sqrt(F.col("shift_x") * F.col("shift_x") + F.col("shift_y") * F.col("shift_y"))
    return raw.withColumn("total_shift_pixels", F.round(total, 2)).withColumn(
        "registration_quality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - total / 5.0)), 4)
    ).withColumn("edge_artifact_risk", F.round(F.when(total > 0.8, F.least(F.lit(1.0), total / 3.0)).otherwise(0.0), 4))

"""Tile grids over scenes and pixels over tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import naming as N, projection as P


def tile_grid(scenes: DataFrame, tile_size: int | None = None, overlap: int | None = None) -> DataFrame:
    """One row per tile: window offsets, clamped window size, bounds and center in degrees.

    Overlap 0 or None means the default.  The count uses the full windows only;
    a window clamped below half a tile is skipped.
    """
    size, lap = tile_size or vocab.TILE_SIZE, overlap or vocab.TILE_OVERLAP
    return _grid(scenes, size, lap, size - lap)


def tile_grid_plain(scenes: DataFrame, tile_size: int = vocab.TILE_SIZE) -> DataFrame:
    """Non-overlapping full tiles only: W // size columns by H // size rows."""
    full = scenes.where((F.col("width") >= tile_size) & (F.col("height") >= tile_size))
    return _grid(full, tile_size, 0, tile_size)


def _grid(scenes: DataFrame, size: int, lap: int, step: int) -> DataFrame:
    count = lambda side: F.greatest(F.lit(1), F.floor((F.col(side) - lap) / F.lit(step)).cast("int"))
    # what a scene's system says is read once per scene; a scene without one has its bounds as they are
    scenes = P.with_zone(scenes, "crs") if "crs" in scenes.columns else scenes
    grid = (
        scenes.withColumn("n_cols", count("width")).withColumn("n_rows", count("height"))
        .withColumn("y_index", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
        .withColumn("x_index", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    )
    grid = grid.withColumns({
        "col_off": F.col("x_index") * step, "row_off": F.col("y_index") * step,
    }).withColumns({
        "win_width": F.least(F.lit(size), F.col("width") - F.col("col_off")),
        "win_height": F.least(F.lit(size), F.col("height") - F.col("row_off")),
    }).where((F.col("win_width") >= size // 2) & (F.col("win_height") >= size // 2))
    x_res = (F.col("bounds_maxx") - F.col("bounds_minx")) / F.col("width")
    y_res = (F.col("bounds_maxy") - F.col("bounds_miny")) / F.col("height")
    tile = {
        "t_minx": F.col("bounds_minx") + F.col("col_off") * x_res,
        "t_maxx": F.col("bounds_minx") + (F.col("col_off") + F.col("win_width")) * x_res,
        "t_maxy": F.col("bounds_maxy") - F.col("row_off") * y_res,
        "t_miny": F.col("bounds_maxy") - (F.col("row_off") + F.col("win_height")) * y_res,
    }
    grid = grid.withColumns(tile).withColumns({"t_cx": (F.col("t_minx") + F.col("t_maxx")) / 2, "t_cy": (F.col("t_miny") + F.col("t_maxy")) / 2})
    # corners and center are converted one by one where the scene names its system
    points = [("t_minx", "t_miny"), ("t_maxx", "t_maxy"), ("t_cx", "t_cy")]
    if "crs" in scenes.columns:
        degrees = {(f"{x}_deg", f"{y}_deg"): (x, y) for x, y in points}
        grid, points = P.with_degrees(grid, "crs", degrees), list(degrees)
    (minx, miny), (maxx, maxy), (cx, cy) = [(F.col(x), F.col(y)) for x, y in points]
    return grid.select(
        N.tile_id(F.col("scene_id"), F.col("x_index"), F.col("y_index")).alias("tile_id"), "scene_id",
        "x_index", "y_index", "col_off", "row_off", "win_width", "win_height",
        minx.alias("bounds_minx"), miny.alias("bounds_miny"), maxx.alias("bounds_maxx"), maxy.alias("bounds_maxy"),
        cx.alias("center_lon"), cy.alias("center_lat"), F.lit(size).alias("width"), F.lit(size).alias("height"),
    )


def pixels_to_tiles(pixels: DataFrame, scenes: DataFrame, tile_size: int, overlap: int) -> DataFrame:
    """Scene pixels (scene_id, row, col, ...) assigned to every tile that covers them (1 to 4).

    The covering tiles are computed from the offsets, so the only join is to one
    row per scene for its dimensions.
    """
    step = tile_size - overlap
    dims = scenes.select("scene_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    count = lambda side: F.greatest(F.lit(1), F.floor((F.col(side) - overlap) / F.lit(step)).cast("int"))

    def cover(at: str, side: str):
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - (tile_size - 1)) / F.lit(step)).cast("int"))
        last = F.least(count(side) - 1, F.floor(F.col(at) / F.lit(step)).cast("int"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    out = pixels.join(dims, "scene_id")
    half = tile_size // 2
    out = out.withColumn("x_index", F.explode(cover("col", "_w"))).withColumn("y_index", F.explode(cover("row", "_h")))
    big_enough = (
        (F.least(F.lit(tile_size), F.col("_w") - F.col("x_index") * step) >= half)
        & (F.least(F.lit(tile_size), F.col("_h") - F.col("y_index") * step) >= half)
    )
    return out.where(big_enough).select(
        N.tile_id(F.col("scene_id"), F.col("x_index"), F.col("y_index")).alias("tile_id"),
        (F.col("row") - F.col("y_index") * step).alias("row"), (F.col("col") - F.col("x_index") * step).alias("col"),
        *[c for c in pixels.columns if c not in ("scene_id", "row", "col")],
    )


def zero_padded(tile_pixels: DataFrame, tile_size: int, bands=("red", "green", "blue", "nir")) -> DataFrame:
    """Every (row, col) of every tile; missing pixels are 0.

    Only the missing positions are generated and added, so present pixels are not joined.
    """
    have = tile_pixels.groupBy("tile_id", "row").agg(F.collect_set("col").alias("_have"))
    every_col = F.sequence(F.lit(0), F.lit(tile_size - 1))
    tiles = tile_pixels.select("tile_id").distinct().withColumn("row", F.explode(every_col))
    gaps = (
        tiles.join(have, ["tile_id", "row"], "left")
        .withColumn("col", F.explode(F.array_except(every_col, F.coalesce("_have", F.array().cast("array<int>")))))
        .select("tile_id", "row", "col", *[F.lit(0).cast(tile_pixels.schema[b].dataType).alias(b) for b in bands])
    )
    return tile_pixels.select("tile_id", "row", "col", *bands).unionByName(gaps)

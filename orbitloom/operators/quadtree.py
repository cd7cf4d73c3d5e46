"""First and last observations around every asked place, over a tree of cells cut by their number of places.

Cells start at the width of the window and are quartered while they hold more than `leaf` distinct places, so a town where half of
an archive lies becomes many small cells and an ocean stays one.  Every cell, inner ones included, carries what its places add up
to.  An asked window goes down the tree: a cell that lies wholly inside answers with its sums, one that lies outside goes, and only
places of the smallest cells on the border are looked at one by one.  A window over n crowded places so touches some sqrt(n) cells.

A cell is inside or outside by the extremes of the places it holds, not by its drawn borders.  Float subtraction is monotone, so the
test `abs(difference) < degrees` of the extremes is the test of every place between them, and the answer is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

LEAF = 64
DEEPEST = 16  # a window of 0.05 degrees halved so often is under 10 cm wide
SALTS = 8  # copies of a cell's row, so that a cell met by very many windows is spread over tasks
CELL = ["level", "r", "c"]
ENDS = ["n", "lo", "hi", "hi2"]


def latest_two(df: DataFrame, keys: list[str]) -> DataFrame:
    """The latest two rows by (o.date, o.tile_id) of each key as (hi, hi2); the rank is cut before the shuffle as well."""
    order = Window.partitionBy(*keys).orderBy(F.col("o.date").desc(), F.col("o.tile_id").desc())
    top = df.select(*keys, "o").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 2)
    return top.groupBy(*keys).agg(F.max(F.when(F.col("_rn") == 1, F.col("o"))).alias("hi"), F.max(F.when(F.col("_rn") == 2, F.col("o"))).alias("hi2"))


def added_ends(parts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Parts (keys, n, lo, hi, hi2) of disjoint observations as one row per key; `more` are further aggregates."""
    first = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), *more)
    ends = parts.select(*keys, F.explode(F.array_compact(F.array("hi", "hi2"))).alias("o"))
    return first.join(latest_two(ends, keys), keys)


def places_with_ends(observations: DataFrame) -> DataFrame:
    """(place, lat, lon, n, lo, hi, hi2) from observations (place, lat, lon, o: struct of date and tile_id)."""
    first = observations.groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count("*").alias("n"), F.min("o").alias("lo"))
    return first.join(latest_two(observations, ["place"]), "place")


def _at(level: int | Column, degrees: float) -> dict[str, Column]:
    """Row and column at a level; doubling is exact, so a cell's parent is its number halved."""
    wide = lambda x: F.floor(F.col(x) / F.lit(degrees) * F.pow(F.lit(2.0), F.lit(level))).cast("bigint")
    return {"level": F.lit(level).cast("int"), "r": wide("lat"), "c": wide("lon")}


def leaf_cells(places: DataFrame, degrees: float, leaf: int = LEAF, deepest: int = DEEPEST) -> DataFrame:
    """`places` with the cell (level, r, c) that holds each; a cell has at most `leaf` places, unless they share the deepest cell.

    Each round cuts only what is still crowded.
    """
    waiting, done = places, []
    for level in range(deepest + 1):
        celled = waiting.withColumns(_at(level, degrees))
        sizes = celled.groupBy(*CELL).agg(F.count("*").alias("size"))
        sized = materialize(celled.join(sizes, CELL), "cells")
        crowded = (F.col("size") > leaf) & F.lit(level < deepest)
        done.append(sized.where(~crowded).drop("size"))
        waiting = sized.where(crowded).drop("size", *CELL)
        if waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def tree_cells(leaves: DataFrame) -> DataFrame:
    """Every cell of the tree with its sums, the extremes of its places and whether it is a leaf."""
    extremes = [f(x).alias(f"{name}_{x}") for x in ("lat", "lon") for name, f in (("least", F.min), ("most", F.max))]
    again = [f(f"{name}_{x}").alias(f"{name}_{x}") for x in ("lat", "lon") for name, f in (("least", F.min), ("most", F.max))]
    low = added_ends(leaves, CELL, *extremes)
    above = low.where("level > 0").withColumn("up", F.explode(F.expr("sequence(0, level - 1)"))).withColumns({
        "r": F.expr("shiftright(r, level - up)"), "c": F.expr("shiftright(c, level - up)"), "level": F.col("up").cast("int")}).drop("up")
    return low.withColumn("is_leaf", F.lit(True)).unionByName(added_ends(above, CELL, *again).withColumn("is_leaf", F.lit(False)))


def window_parts(asked: DataFrame, places: DataFrame, degrees: float, leaf: int = LEAF, deepest: int = DEEPEST) -> DataFrame:
    """(place, whole, n, lo, hi, hi2): the cells (`whole`) and single places that make up the window around each asked place.

    `asked`: distinct (place, lat, lon); `places`: as of `places_with_ends`.  Windows are open: a place at exactly `degrees` is outside.
    """
    leaves = leaf_cells(materialize(places, "places"), degrees, leaf, deepest)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    cells = materialize(tree_cells(leaves), "tree").select("*", salts)
    single = leaves.select(*CELL, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *ENDS, salts)
    near = lambda other, own: F.abs(F.col(other) - F.col(own)) < degrees
    outside = reduce(Column.__or__, [(F.col(f"least_{x}") - F.col(x) >= degrees) | (F.col(x) - F.col(f"most_{x}") >= degrees) for x in ("lat", "lon")])
    inside = reduce(Column.__and__, [near(f"{end}_{x}", x) for end in ("least", "most") for x in ("lat", "lon")])

    steps, halves = F.array(*map(F.lit, (-1, 0, 1))), F.array(F.lit(0), F.lit(1))
    front = asked.select("place", "lat", "lon", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int").alias("_salt")).withColumns(_at(0, degrees))
    front = front.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
    front = front.withColumns({"r": F.col("r") + F.col("_dr"), "c": F.col("c") + F.col("_dc")}).drop("_dr", "_dc")
    parts = []
    for _ in range(deepest + 1):
        met = front.join(cells, [*CELL, "_salt"]).where(~outside).withColumn("whole", inside)
        ends = [F.when(F.col("whole"), F.col(e)).alias(e) for e in ENDS]
        met = materialize(met.select("place", "lat", "lon", *CELL, "_salt", "whole", "is_leaf", *ends), "met")
        border = met.where("NOT whole")
        rows = border.where("is_leaf").drop(*ENDS).join(single, [*CELL, "_salt"]).where(near("_lat", "lat") & near("_lon", "lon"))
        parts += [met.where("whole").select("place", "whole", *ENDS), rows.select("place", "whole", *ENDS)]
        front = border.where("NOT is_leaf").select("place", "lat", "lon", "_salt", "level", "r", "c")
        if front.isEmpty():
            break
        front = front.withColumn("_dr", F.explode(halves)).withColumn("_dc", F.explode(halves)).select(
            "place", "lat", "lon", "_salt", (F.col("level") + 1).cast("int").alias("level"),
            (F.col("r") * 2 + F.col("_dr")).alias("r"), (F.col("c") * 2 + F.col("_dc")).alias("c"))
    return reduce(DataFrame.unionByName, parts)


def window_ends(asked: DataFrame, places: DataFrame, degrees: float, leaf: int = LEAF, deepest: int = DEEPEST) -> DataFrame:
    """(place, n, lo, hi, hi2): number, earliest and latest two of the observations around each asked place; places without any are left out."""
    return added_ends(materialize(window_parts(asked, places, degrees, leaf, deepest), "parts"), ["place"])

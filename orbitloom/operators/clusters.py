"""Density clusters of observed sites.

A location is *core* if at least `min_tiles` tiles lie within `degrees` of it (strict, per axis, itself included).  Core
locations within `degrees` of each other are one cluster, named by its smallest tile id; another location near a core
one is on the *border* of the cluster with the smallest name, and what is left is *noise*.

Everything works on distinct locations: a place photographed a million times is one node with a count.  Nodes meet on a
grid of cells, so no pair beyond the eight neighbouring cells is looked at.  Clusters grow by the smallest
name among the neighbours and by jumping to the name's own name, which needs about as many rounds as the logarithm of a
cluster's width; each round is a written table, so a lost executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..session import materialize


def location_nodes(tiles: DataFrame, within: list[str]) -> DataFrame:
    """(node, *within, lat, lon, n): distinct locations, named by their smallest tile id; tiles without a center are left out."""
    return tiles.where("center_lat IS NOT NULL AND center_lon IS NOT NULL").groupBy(
        *within, (F.col("center_lat") + 0.0).alias("lat"), (F.col("center_lon") + 0.0).alias("lon")
    ).agg(F.min("tile_id").alias("node"), F.count("*").alias("n"))


def near_nodes(nodes: DataFrame, within: list[str], degrees: float) -> DataFrame:
    """(node, other, n): each node with every node near it, itself included, and the other's number of tiles."""
    row, column = F.floor(F.col("lat") / F.lit(degrees)), F.floor(F.col("lon") / F.lit(degrees))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asking = nodes.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps)).select(
        *within, "node", "lat", "lon", (row + F.col("_dr")).alias("_r"), (column + F.col("_dc")).alias("_c"))
    asked = nodes.select(*within, F.col("node").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "n", row.alias("_r"), column.alias("_c"))
    close = (F.abs(F.col("lat") - F.col("lat2")) < degrees) & (F.abs(F.col("lon") - F.col("lon2")) < degrees)
    return asking.join(asked, [*within, "_r", "_c"]).where(close).select("node", "other", "n")


def smallest_names(links: DataFrame) -> DataFrame:
    """(node, cluster): the smallest node that each node reaches along `links` (node, other), which hold both directions
    and every node itself."""
    names = materialize(links.groupBy("node").agg(F.min("other").alias("cluster")), "names")
    while True:
        of_other = names.select(F.col("node").alias("other"), F.col("cluster").alias("c"))
        lowest = links.join(of_other, "other").groupBy("node").agg(F.min("c").alias("low"))
        # a name is a node as well: its own name is at least as small
        jumped = lowest.join(names.select(F.col("node").alias("low"), F.col("cluster").alias("lower")), "low").select("node", F.least("low", "lower").alias("cluster"))
        new = materialize(jumped, "names")
        moved = new.join(names.withColumnRenamed("cluster", "before"), "node").where("cluster <> before").limit(1).count()
        names = new
        if not moved:
            return names


def site_clusters(tiles: DataFrame, within: list[str] | None = None, degrees: float = vocab.COLOCATION_DEGREES, min_tiles: int = 4) -> DataFrame:
    """(tile_id, role, cluster): every tile that has a center, with its location's role and cluster (null: noise).

    `within` limits clusters to tiles that are equal in these columns (which are not null), such as one scene's.
    """
    within = within or []
    nodes = materialize(location_nodes(tiles, within), "nodes")
    near = materialize(near_nodes(nodes, within, degrees), "near")
    core = materialize(near.groupBy("node").agg(F.sum("n").alias("seen")).where(F.col("seen") >= min_tiles).select("node"), "core")
    to_core = near.select("node", "other").join(core.withColumnRenamed("node", "other"), "other", "left_semi")
    names = smallest_names(materialize(to_core.join(core, "node", "left_semi"), "links"))
    border = to_core.join(core, "node", "left_anti").join(names.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("cluster").alias("cluster"))
    found = names.withColumn("role", F.lit("core")).unionByName(border.withColumn("role", F.lit("border")))
    placed = nodes.join(found, "node", "left").select(*within, "lat", "lon", F.coalesce("role", F.lit("noise")).alias("role"), "cluster")
    at = tiles.select(*within, "tile_id", (F.col("center_lat") + 0.0).alias("lat"), (F.col("center_lon") + 0.0).alias("lon"))
    return at.join(placed, [*within, "lat", "lon"]).select("tile_id", "role", "cluster")

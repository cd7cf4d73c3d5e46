"""The walk back through the images of a site."""

from __future__ import annotations

import datetime as dt

import numpy as np

from orbitloom.plans.change_analysis import change_shares, earliest_supported_pixels

SIDE = 32


def _image(block):
    """A fixed texture with a bright block at one of two places (0: none)."""
    img = 90 + (np.add.outer(np.arange(SIDE) * 3, np.arange(SIDE) * 5) % 17)
    if block:
        at = 4 if block == 1 else 18
        img[at:at + 10, at:at + 10] += 120
    return img


# per site the blocks of its images in order of date; None: no image
SITES = {
    "walks": [2, 1, 1, 1, 2],
    "stops": [1, 2, 2],
    "gap": [1, None, 1, 2],
    "long": [1] * 9 + [2],
    "lost": [1, 1, None],
    "single": [1],
}
# run, index of the earliest date
WANT = {"walks": (3, 1), "stops": (0, 2), "gap": (2, 0), "long": (9, 0), "lost": (0, None), "single": (0, None)}


def _frames(spark, sites):
    day = dt.date(2024, 1, 1)
    obs = [(s, f"{s}{i:02d}", f"{s}_{i}", day + dt.timedelta(i)) for s, b in sites.items() for i in range(len(b))]
    px = [(f"{s}_{i}", r, c, *[int(_image(x)[r, c])] * 3, None) for s, b in sites.items() for i, x in enumerate(b) if x is not None
          for r in range(SIDE) for c in range(SIDE)]
    return (spark.createDataFrame(obs, "site string, obs_id string, tile_id string, date date"),
            spark.createDataFrame(px, "tile_id string, row int, col int, red int, green int, blue int, nir int"))


def test_walk_back(spark):
    obs, px = _frames(spark, SITES)
    undated = spark.createDataFrame([("walks", "w99", "walks_9", None)], obs.schema)
    got = {r.site: r for r in earliest_supported_pixels(obs.unionByName(undated), px).collect()}
    for site, (run, first) in WANT.items():
        assert got[site].observations == len(SITES[site])
        assert got[site].run_length == run, site
        assert got[site].earliest_supported == (None if first is None else dt.date(2024, 1, 1 + first)), site
    assert got["stops"].compared == 1 and got["walks"].compared <= 2 * 4


def test_no_common_pixels_and_empty_tables(spark):
    obs, px = _frames(spark, {"a": [1, 2]})
    pairs = spark.createDataFrame([("p", "a_0", "none")], "pair_id string, t1_tile_id string, t2_tile_id string")
    assert change_shares(pairs, px).first().change_pct is None
    assert earliest_supported_pixels(obs.where("false"), px).count() == 0
    only = earliest_supported_pixels(obs, px.where("false")).first()
    assert only.earliest_supported is None and only.run_length == 0

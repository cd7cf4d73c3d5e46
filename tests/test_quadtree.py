"""Windows over crowded places against a brute-force loop."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from orbitloom.operators import quadtree as Q

DEGREES = 0.05


def _observations(seed: int, crowd: int, spread: int, repeats: int):
    """Half of all in one cell at different centers, some at one exact center, the rest anywhere; few dates, so that many tie."""
    r = random.Random(seed)
    at = [(10.001 + r.random() * 0.048, 20.001 + r.random() * 0.048) for _ in range(crowd)]
    at += [(10.02, 20.03)] * repeats + [(r.uniform(9.8, 10.2), r.uniform(19.8, 20.2)) for _ in range(spread)]
    at += [(-0.01, -0.02), (0.04, -0.02), (-0.01, 0.03), (10.0, 20.0), (10.05, 20.0), (10.1, 20.05)]  # across zero and on borders of cells
    return [(f"{a},{b}", a, b, dt.date(2024, 1, 1 + r.randrange(9)), f"t{i:05d}") for i, (a, b) in enumerate(at)]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "place string, lat double, lon double, date date, tile_id string")
    return df.select("place", "lat", "lon", F.struct("date", "tile_id").alias("o"))


def _brute(rows):
    out = {}
    for place, a, b in {r[:3] for r in rows}:
        seen = sorted((r[3], r[4]) for r in rows if abs(r[1] - a) < DEGREES and abs(r[2] - b) < DEGREES)
        out[place] = (len(seen), seen[0], seen[-1], seen[-2] if len(seen) > 1 else None)
    return out


def _found(df):
    return {r.place: (r.n, tuple(r.lo), tuple(r.hi), tuple(r.hi2) if r.hi2 else None) for r in df.collect()}


def test_crowded_cell_equals_brute_force(spark):
    rows = _observations(1, 400, 300, 40)
    obs = _frame(spark, rows)
    asked = obs.select("place", "lat", "lon").distinct()
    assert _found(Q.window_ends(asked, Q.places_with_ends(obs), DEGREES, leaf=8)) == _brute(rows)
    assert _found(Q.window_ends(asked, Q.places_with_ends(obs), DEGREES)) == _brute(rows)


def test_deepest_cell_may_stay_crowded(spark):
    rows = _observations(2, 60, 20, 5)
    obs = _frame(spark, rows)
    asked = obs.select("place", "lat", "lon").distinct()
    assert _found(Q.window_ends(asked, Q.places_with_ends(obs), DEGREES, leaf=1, deepest=2)) == _brute(rows)


def test_leaves_are_bounded_and_cover_every_place(spark):
    obs = _frame(spark, _observations(3, 500, 200, 30))
    places = Q.places_with_ends(obs)
    leaves = Q.leaf_cells(places, DEGREES, leaf=10)
    assert leaves.count() == places.count()
    assert leaves.groupBy(*Q.CELL).count().agg(F.max("count")).first()[0] <= 10


def test_work_grows_slower_than_the_pairs(spark):
    """Twice the crowd: the rows looked into grow by less than the pairs of places do."""
    looked = []
    for crowd in (600, 1200):
        rows = _observations(4, crowd, 0, 0)
        obs = _frame(spark, rows)
        parts = Q.window_parts(obs.select("place", "lat", "lon").distinct(), Q.places_with_ends(obs), DEGREES, leaf=8)
        looked.append(parts.count() / crowd ** 2)
    assert looked[0] < 0.25
    assert looked[1] < 0.75 * looked[0]


def test_empty(spark):
    obs = _frame(spark, _observations(5, 3, 0, 0))
    none = obs.where("false")
    asked = obs.select("place", "lat", "lon").distinct()
    assert Q.window_ends(asked, Q.places_with_ends(none), DEGREES).count() == 0
    assert Q.window_ends(asked.where("false"), Q.places_with_ends(obs), DEGREES).count() == 0

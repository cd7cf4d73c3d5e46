import random

from orbitloom.operators import clusters as C


def brute(points, degrees, least):
    """Roles and clusters of (tile, lat, lon) by all pairs and a search along them."""
    near = {t: [u for u, b, m in points if abs(a - b) < degrees and abs(l - m) < degrees] for t, a, l in points}
    core = {t for t in near if len(near[t]) >= least}
    name = {}
    for t in sorted(core):
        todo = [] if t in name else [t]
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = t
                todo += [y for y in near[x] if y in core]
    out = {}
    for t in near:
        around = [name[u] for u in near[t] if u in core]
        out[t] = ("core", name[t]) if t in core else ("border", min(around)) if around else ("noise", None)
    return out


def test_clusters_equal_a_search_over_all_pairs(spark):
    rng = random.Random(1)
    points = [(f"t{i:03d}", round(rng.uniform(-1, 1), 2) + 0.001, round(rng.uniform(-1, 1), 2) + 0.001) for i in range(260)]
    points += [(f"u{i:03d}", 0.501, 0.501) for i in range(200)]  # one place that holds much of the table
    points += [(f"v{i:03d}", 3.001 + 0.03 * i, 0.001) for i in range(60)]  # a long chain
    tiles = spark.createDataFrame([(*p, "x") for p in points] + [("lost", None, 1.0, "x")], "tile_id string, center_lat double, center_lon double, role string")
    got = {r.tile_id: (r.role, r.cluster) for r in C.site_clusters(tiles, degrees=0.05, min_tiles=3).collect()}
    assert got == brute(points, 0.05, 3)
    assert {role for role, _ in got.values()} == {"core", "border", "noise"} and len({got[f"v{i:03d}"][1] for i in range(60)}) == 1


def test_clusters_stay_within_their_column_and_empty_tables_have_none(spark):
    rows = [(f"{s}{i}", 0.01 * i + 0.001, 0.001, s) for s in "ab" for i in range(3)]
    tiles = spark.createDataFrame(rows, "tile_id string, center_lat double, center_lon double, scene_id string")
    got = {r.tile_id: r.cluster for r in C.site_clusters(tiles, ["scene_id"], 0.05, 3).collect()}
    assert got == {t: f"{t[0]}0" for t in got} and len(got) == 6
    assert {r.role for r in C.site_clusters(tiles, ["scene_id"], 0.05, 4).collect()} == {"noise"}
    assert C.site_clusters(tiles.limit(0), ["scene_id"]).count() == 0

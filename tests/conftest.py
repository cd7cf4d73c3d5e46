import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from orbitloom.session import build_session

    s = build_session("tests", master="local[8]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scenes_and_tiles(spark):
    """Two grid positions, three dates and one undated scene."""
    from pyspark.sql import functions as F

    scenes = spark.createDataFrame(
        [("s1", "Sentinel-2", "2024-01-10"), ("s2", "Landsat-8", "2024-04-10"), ("s3", "Sentinel-2", "2024-09-01"), ("s4", "Sentinel-1", None)],
        "scene_id string, sensor string, d string",
    ).select("scene_id", "sensor", F.col("d").cast("date").alias("acquisition_date"))
    rows = []
    for s in range(1, 5):
        for x, lon in enumerate((91.70, 91.74, 92.50)):
            rows.append((f"t{s}_{x}", f"s{s}", x, 0, lon, 26.10, lon - 0.01, 26.09, lon + 0.01, 26.11))
    tiles = spark.createDataFrame(
        rows, "tile_id string, scene_id string, x_index int, y_index int, center_lon double, center_lat double, "
        "bounds_minx double, bounds_miny double, bounds_maxx double, bounds_maxy double")
    return scenes, tiles

"""Intermediate tables of jobs that shuffle whole texts several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back; the shuffle files it took are removed as soon as it is written.
    The setting is the session's only meanwhile."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)

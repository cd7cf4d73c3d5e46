"""Exact ranks and order statistics that never sort one hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_BUCKETS = 4096
SKETCH_ACCURACY = 10_000


def hash_order(keys: list[str], seed: int | str) -> Column:
    """A seeded pseudo-random order that any engine can reproduce."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_ranked(df: DataFrame, keys: list[str], seed: int | str, rank: str = "rank") -> DataFrame:
    """1-based position of every row in seeded hash order over the whole table.

    The hash is uniform, so its first three digits cut the table into 4,096 even
    buckets: rows are numbered inside their bucket and shifted by the sizes of
    the buckets before it.  The bucket table has at most 4,096 rows, which is the
    bound that allows the broadcast and the one-partition running sum.
    """
    hashed = df.withColumn("_h", hash_order(keys, seed)).withColumn(
        "_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    )
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy("_h", *keys)
    return (
        hashed.join(F.broadcast(offsets), "_b")
        .withColumn(rank, (F.row_number().over(inside) + F.col("_off")).cast("bigint"))
        .drop("_h", "_b", "_off")
    )


def date_ordered(df: DataFrame, site: list[str], date: str, then: list[Column], position: str = "position") -> DataFrame:
    """1-based position of every row of a site by date, undated rows last.

    A hot site is split by its dates: rows are numbered per (site, date) and
    shifted by the running count of the site's earlier dates, so the largest sort
    is one day of one site.
    """
    keys = [*site, date]
    per_day = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    running = (
        Window.partitionBy(*site).orderBy(F.col(date).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_day.select(*keys, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys).orderBy(*then)
    numbered = df.withColumn("_rn", F.row_number().over(inside)).alias("l")
    on = [F.col(f"l.{s}") == F.col(f"r.{s}") for s in site] + [F.col(f"l.{date}").eqNullSafe(F.col(f"r.{date}"))]
    joined = numbered.join(offsets.alias("r"), on)
    return joined.select("l.*", (F.col("_rn") + F.col("_off")).cast("bigint").alias(position)).drop("_rn")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact interpolated percentiles per key as columns `p<prob*100>`, plus `n` and `mean`.

    A mergeable sketch brackets each percentile; only rows inside a bracket (a few
    ten-thousandths of a large group) are counted by value and walked, so a key
    that holds most of the table is never collected.  Groups of up to 10,000 rows
    are walked whole.
    """
    names = [f"p{round(p * 100)}" for p in probs]
    pad = 3.0 / SKETCH_ACCURACY
    marks = [m for p in probs for m in (max(0.0, p - pad), min(1.0, p + pad))]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("_v").alias("mean"),
        F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), SKETCH_ACCURACY).alias("_q"),
    )
    if keys:
        marked = sketch.select(*keys, F.explode(_brackets(probs, F.col("n"), F.col("_q"))).alias("b")).select(*keys, "b.*")
        joined = rows.join(marked, keys)
    else:  # one sketch row for the whole table: its numbers become literals
        whole = sketch.first()
        marks_now = F.array(*[F.lit(float(m)) for m in whole["_q"] or [0.0] * len(marks)])
        joined = rows.select("_v", F.explode(_brackets(probs, F.lit(whole["n"]), marks_now)).alias("b")).select("_v", "b.*")
    below = joined.where(F.col("_v") < F.col("lo")).groupBy(*keys, "i").agg(F.count("*").alias("below"))
    inside = (
        joined.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        .groupBy(*keys, "i", "pos", "_v").agg(F.count("*").alias("c"))
        .join(below, [*keys, "i"], "left")
    )
    w = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    walked = inside.withColumn("upto", F.sum("c").over(w) + F.coalesce("below", F.lit(0)))
    lo_i, hi_i = F.floor("pos"), F.ceil("pos")
    at = lambda idx: F.min(F.when(F.col("upto") > idx, F.col("_v")))
    stats = walked.groupBy(*keys, "i").agg(at(lo_i).alias("a"), at(hi_i).alias("z"), F.first("pos").alias("pos"))
    stats = stats.withColumn("x", F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("z") - F.col("a")))
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(n) for i, n in enumerate(names)])
    return sketch.drop("_q").join(wide, keys) if keys else one_row(sketch.drop("_q"), wide)


def _brackets(probs: list[float], n: Column, marks: Column) -> Column:
    """Per percentile: index, bracket and exact position; a small group has an open bracket."""
    inf = F.lit(float("inf"))
    whole = n <= SKETCH_ACCURACY
    return F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.when(whole, -inf).otherwise(marks[2 * i]).alias("lo"),
            F.when(whole, inf).otherwise(marks[2 * i + 1]).alias("hi"), (F.lit(p) * (n - 1)).alias("pos"),
        ) for i, p in enumerate(probs)
    ])


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side, without a join."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])

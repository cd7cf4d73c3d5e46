"""URL filter as a sort-merge range join (DataFrame functions only).

A rule names a host (it and all subdomains) and a path prefix.  Reversing the labels of a host turns "all subdomains"
into a key prefix, and a key prefix is an interval of the sorted keys.  `sweep` walks the sorted starts, ends and points
once: the running depth is the height of the stack of open intervals, and the open interval of level d is the last one
that started at level d.  Hosts are swept first, then the paths below each open host.

Defined results: a null url, or one without `://`, has an empty host and path; a host is lower-cased in A-Z only; rules
that are listed twice count once, and of two verdicts for one (host, path) the alphabetically last, "block", holds; the
longest rule (host and path together, then host) wins; a page without a fitting rule gets the default verdict.  Repeated
page rows each get a row.  Other columns of the pages pass through unless they bear the names of the result's columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, START, POINT = 0, 1, 2  # at equal keys an interval is closed before another opens, and open before a point asks


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot, in hexadecimal: sorts as the bytes do, and leaves
    room for an end mark above every continuation."""
    return F.hex(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(points: DataFrame, prefixes: DataFrame, innermost: bool = False) -> DataFrame:
    """The prefixes that each point key starts with: (key, level, prefix), level 1 the outermost; only the innermost
    one with `innermost`.  Both inputs hold one hexadecimal column `key` of distinct values.

    The events are range-partitioned by key; what is open when a partition begins comes from one row per partition.
    """
    spark = points.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = reduce(DataFrame.unionByName, (
        prefixes.select(F.concat("key", F.lit("G")).alias("key"), F.lit(END).alias("kind"), F.lit(-1).alias("step")),
        prefixes.select("key", F.lit(START).alias("kind"), F.lit(1).alias("step")),
        points.select("key", F.lit(POINT).alias("kind"), F.lit(0).alias("step")),
    ))
    dealt = materialize(events.repartitionByRange(parts, "key", "kind").withColumn("part", F.spark_partition_id()), "sweep")

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    opened = dealt.groupBy("part").agg(F.sum("step").alias("step")).select(
        "part", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("height"))
    here = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    depth = dealt.join(F.broadcast(opened), "part").withColumn("depth", F.col("height") + F.sum("step").over(here))

    starts = depth.where(F.col("kind") == START).select("part", "key", "kind", F.col("depth").alias("level"))
    asked = depth.where((F.col("kind") == POINT) & (F.col("depth") > 0))
    level = F.col("depth") if innermost else F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth")))
    asked = asked.select("part", "key", "kind", level.alias("level"))
    # what was open at a level where a partition begins: the last start of an earlier partition at that level
    last = starts.groupBy("level", "part").agg(F.max("key").alias("last"))
    carried = W.partitionBy("level").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    known = last.select("level", "part", "last").unionByName(
        asked.select("level", "part", F.lit(None).cast("string").alias("last")).distinct()
    ).groupBy("level", "part").agg(F.max("last").alias("last")).select(
        "level", "part", F.last("last", ignorenulls=True).over(carried).alias("carry"))
    in_level = W.partitionBy("part", "level").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    own = F.when(F.col("kind") == START, F.col("key"))
    return (
        starts.unionByName(asked.select(starts.columns))
        .withColumn("prefix", F.last(own, ignorenulls=True).over(in_level))
        .where(F.col("kind") == POINT)
        .join(known, ["level", "part"], "left")
        .select("key", "level", F.coalesce("prefix", "carry").alias("prefix"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict; `rules`: (host, path, verdict)."""
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("rule_key", host_key(F.col("rule_host")))
    )
    split = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    places = materialize(split.select("host", "path").distinct().withColumn("key", host_key(F.col("host"))), "places")

    hosts = sweep(places.select("key").distinct(), rules.select(F.col("rule_key").alias("key")).distinct())
    below = F.concat("rule_key", F.lit("0000"), F.hex("path"))  # 0000 ends the host part
    asked = materialize(
        places.join(hosts.select("key", F.col("prefix").alias("rule_key")), "key")
        .select("host", "path", "rule_key", below.alias("key")), "asked")
    by_path = rules.withColumn("prefix", F.concat("rule_key", F.lit("0000"), F.hex("rule_path")))
    fits = sweep(asked.select("key").distinct(), by_path.select(F.col("prefix").alias("key")).distinct(), innermost=True)
    rank = F.struct(F.char_length("rule_host") + F.char_length("rule_path"), F.char_length("rule_host"))
    best = (
        asked.join(fits.select("key", "prefix"), "key").join(by_path, "prefix")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("won"))
    )
    # the input row is nested, so that none of its columns meets a name used here
    rows = split.select(F.struct("*").alias("row"), "host", "path")
    return rows.join(best, ["host", "path"], "left").select(
        *[F.col("row")[c].alias(c) for c in split.columns], F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))

"""Line deduplication over overlapping three-line windows (DataFrame functions only).

Every three consecutive lines of a document form a window.  Windows with equal lines, anywhere in the table, are one
repeated passage; its first occurrence by (doc_id, position) stays and the positions under every later one are merged
and removed.  The earliest occurrence of any line is never removed, so no line vanishes from the corpus.

Defined results: lines end at `\\n`; a null text stays null and has no lines; a text of fewer than three lines has no
window and stays as it is; an empty line is a line.  A null doc_id sorts first.  Repeated rows (equal doc_id and text)
are one document and are all treated alike.  Other columns pass through, whatever their names, unless they bear a result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, position, a, b): each window's place and 128-bit hash.  A line is hashed once."""
    hashed = docs.select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("version"),
        F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(SPAN), x).alias("b"))).alias("h"),
    ).where(F.size("h") >= SPAN)
    runs = [F.slice("h", i + 1, F.size("h") - (SPAN - 1)).alias(f"l{i}") for i in range(SPAN)]
    placed = hashed.select("doc", "version", F.posexplode(F.arrays_zip(*runs)).alias("position", "w"))
    lines = [F.col(f"w.l{i}") for i in range(SPAN)]
    return placed.select(
        "doc", "version", "position", F.xxhash64(*[x["a"] for x in lines]).alias("a"), F.xxhash64(*[x["b"] for x in lines]).alias("b"))


def later_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, starts): for each document the sorted starts of its windows that occurred before."""
    w = windows(docs, key, text)
    place = F.struct("doc", "version", "position")
    first = w.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    return (
        w.join(first, ["a", "b"]).where(place != F.col("first"))
        .groupBy("doc", "version").agg(F.array_sort(F.collect_set("position")).alias("starts"))
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "text", removed: str = "n_removed") -> DataFrame:
    """`docs` with the remaining text in `kept` and the number of removed lines in `removed`.

    Kept runs lie between one covered window's end and the next start, so the work is linear in a document's lines.
    """
    later = later_windows(docs, key, text)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("of"), F.xxhash64(text).alias("hash"))
    held = rows.join(later, F.col("of").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("version")), "left").withColumns(
        {"lines": _lines(F.col("row")[text])}).withColumn("n", F.size("lines"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-SPAN)), "starts"), F.concat("starts", F.array("n")),
        lambda a, b: F.struct((a + SPAN + 1).alias("at"), F.greatest(b - a - SPAN, F.lit(0)).alias("size")))
    left = F.flatten(F.transform("runs", lambda r: F.slice("lines", r["at"], r["size"])))
    cut = F.col("starts").isNotNull()
    held = held.withColumn("runs", runs).withColumn("left", F.when(cut, left))
    out = {
        removed: F.when(cut, F.col("n") - F.size("left")).otherwise(F.lit(0)).cast("long"),
        kept: F.when(cut, F.array_join("left", "\n")).otherwise(F.col("row")[text]),
    }
    # the input row is nested, so that none of its columns meets a name used here; both results replace columns in place
    names = [*docs.columns, *(c for c in out if c not in docs.columns)]
    return held.select(*[(out[c] if c in out else F.col("row")[c]).alias(c) for c in names])

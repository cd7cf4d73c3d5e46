"""Small column helpers shared by every module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def stable_int(c: Column) -> Column:
    """A non-negative integer from the first 8 hex digits of md5: the same on every worker and in SQL."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def key_id(prefix: str, *parts: Column) -> Column:
    """`prefix` and the hash of the natural key, whole: a retried task gives the same id, and no two keys share one.
    The first digits are enough for a display (`display_id`)."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.sha2(key, 256))


def display_id(c: Column | str, digits: int = 8) -> Column:
    return F.regexp_extract(col(c), rf"^([^-]*-[0-9a-f]{{0,{digits}}})", 1)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_contained(column: str, words) -> Column:
    """How many of the (plain, quote-free) words occur in a text column."""
    return F.expr(" + ".join(f"int(contains({column}, '{w}'))" for w in words))


def lookup(c: Column, table) -> Column:
    """`when` chain over a fixed (key, value) table; null when absent."""
    out = None
    for k, v in table:
        val = v if isinstance(v, Column) else F.lit(v)
        out = F.when(c == k, val) if out is None else out.when(c == k, val)
    return out


def string_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])

"""Which entries of a dictionary table occur in which texts.

The dictionary is data, not code: it may hold a hundred thousand place names.  Each entry is found by one of its pieces, the *anchor*:
six characters of it (three for entries under six, the whole entry under three), the piece that the fewest entries share, so
that common beginnings ("lake ", "new ") do not gather candidates.  Distinct texts are cut into their distinct pieces, pieces meet
anchors in an equi-join, and what met is confirmed on the text.  Nothing is compiled per entry, and work grows with the texts and what they hold.

Texts and entries are compared as they are: lower them first.  Null and empty entries occur nowhere, a null text holds nothing; equal
entries and equal texts are looked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from ..sources.tables import spread

PIECES = (6, 3, 2, 1)
ROWS_PER_TASK = 2_000  # texts that a task cuts into pieces
BORDER = "\u0001"
_WORD = "[A-Za-z0-9_]"


def bordered(text: Column) -> Column:
    """The text with a mark wherever a word begins or ends: an entry stands as whole words where its bordered form occurs.
    A mark that the text holds itself is taken for a blank."""
    return F.regexp_replace(F.translate(text, BORDER, " "), rf"(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD})", BORDER)


def _pieces(text: Column, length: int) -> Column:
    """The distinct substrings of one length, read in one pass; none where the text is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def anchored(entries: DataFrame) -> DataFrame:
    """(form, anchor) for each distinct (form): its piece that the fewest entries hold, ties to the smaller piece."""
    f = F.col("form")
    own = reduce(lambda rest, n: F.when(F.char_length(f) >= n, _pieces(f, n)).otherwise(rest), sorted(PIECES)[1:], _pieces(f, 1))
    cut = entries.select("form").distinct().select("form", F.explode(own).alias("anchor"))
    counts = cut.groupBy("anchor").agg(F.count("*").alias("_n"))
    return cut.join(counts, "anchor").groupBy("form").agg(F.min(F.struct("_n", "anchor")).alias("_a")).select("form", "_a.anchor")


def found_entries(texts: DataFrame, text: str, entries: DataFrame, entry: str, whole_words: bool = False) -> DataFrame:
    """(text, entry): every distinct pair of a text and an entry that occurs in it, as whole words or anywhere."""
    return held_entries(texts, text, entries, entry, whole_words).select("text", F.explode("entries").alias("entry"))


def held_entries(texts: DataFrame, text: str, entries: DataFrame, entry: str, whole_words: bool = False) -> DataFrame:
    """(text, entries): each distinct text that holds an entry, once, with all entries that occur in it.

    Texts of a third of all rows may be equal: they are one row here.  A piece that very many texts hold meets few
    entries, since no entry is anchored at a piece that others share if it has another one.
    """
    form = bordered if whole_words else (lambda c: c)
    words = entries.select(F.col(entry).alias("entry")).where("entry <> ''").distinct().withColumn("form", form(F.col("entry")))
    here = texts.select(F.col(text).alias("text")).where("text <> ''").distinct().withColumn("_shape", form(F.col("text")))
    here = materialize(here.withColumn("_key", F.sha2("text", 256)), "texts")
    # written, so that a dictionary under Spark's broadcast limit is known to be small
    known = materialize(anchored(words).join(words, "form"), "anchors")
    lengths = [r[0] for r in known.select(F.char_length("anchor")).distinct().collect()]  # at most as many as PIECES
    shape = F.col("_shape")
    none = F.array().cast("array<string>")
    # a text is thousands of pieces, and only those as long as an anchor can meet one
    cut = spread(here, ROWS_PER_TASK).select("_key", F.explode(F.concat(none, *[_pieces(shape, n) for n in sorted(lengths)])).alias("anchor"))
    candidates = cut.join(known, "anchor").select("_key", F.struct("form", "entry", (F.col("form") == F.col("anchor")).alias("sure")).alias("c"))
    # a text meets its candidates as one list: beside each of them it would be copied and compared as often
    met = candidates.groupBy("_key").agg(F.collect_list("c").alias("_met")).join(here, "_key")
    held = F.filter("_met", lambda c: c["sure"] | F.contains(shape, c["form"]))
    return met.select("text", F.transform(held, lambda c: c["entry"]).alias("entries")).where(F.size("entries") > 0)


def first_entry(texts: DataFrame, text: str, entries: DataFrame, entry: str, order: str, whole_words: bool = True) -> DataFrame:
    """`texts` with the entry of the lowest `order` that occurs in them (null if none), as column `entry`."""
    ranked = entries.groupBy(F.col(entry).alias("entry")).agg(F.min(order).alias("_order"))
    hit = found_entries(texts, text, entries, entry, whole_words).join(ranked, "entry")
    best = hit.groupBy("text").agg(F.min(F.struct("_order", "entry")).alias("_b")).select(F.col("text").alias("_t"), F.col("_b.entry").alias("entry"))
    return texts.join(best, F.col(text) == F.col("_t"), "left").drop("_t")


def labels_of(texts: DataFrame, text: str, entries: DataFrame, entry: str, label: str) -> DataFrame:
    """(text, label, n): the labels whose entries occur anywhere in each distinct text, and how many of a label's entries do."""
    hit = found_entries(texts, text, entries, entry)
    pairs = entries.select(F.col(entry).alias("entry"), F.col(label).alias("label")).distinct()
    return hit.join(pairs, "entry").groupBy("text", "label").agg(F.count("*").alias("n"))

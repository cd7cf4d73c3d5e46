"""Filters, intent and the distilled prompt of a query text, as column expressions.

Patterns are literals, so they are compiled once and stay in generated code; only
the removal of the matched place name uses a per-row pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from .common import count_contained

# --- fixed values: patterns of the text grammar
BBOX = r"\[\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\]"
MONTH_RANGE = r"(?:between|from)\s+([a-zA-Z]+)\s+(?:and|to)\s+([a-zA-Z]+)(?:\s+(\d{4}))?"
MONTH_ONE = r"\b(?:in|during)\s+([a-zA-Z]+)\s+(\d{4})\b"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
CLOUD = r"cloud(?:\s*cover)?\s*(?:<|<=|less\s+than|under|below)\s*(\d+)\s*%"
STRIP_CLAUSES = (
    r"(?i)(?:between|from)\s+[a-zA-Z]+\s+(?:and|to)\s+[a-zA-Z]+(?:\s+\d{4})?",
    r"(?i)\b(?:in|during)\s+[a-zA-Z]+\s+\d{4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?i)\bwith\s+cloud(?:\s*cover)?\s*(?:<|<=|less\s+than|under|below)\s*\d+\s*%?",
    r"\[\s*-?\d+\.?\d*\s*,\s*-?\d+\.?\d*\s*,\s*-?\d+\.?\d*\s*,\s*-?\d+\.?\d*\s*\]",
)
LEADING_VERB = r"(?i)^(?:show\s+me|show|find|search\s+for|locate|look\s+for|detect)\s+"


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def with_lowered(df: DataFrame, text: str) -> DataFrame:
    """Stage 1: `_base` (trimmed) and `_low` (lower case).

    The stages below are separate projections on purpose: each reads columns of
    the one before more than once, so Spark keeps them apart, nothing is computed
    twice and every generated method stays small.
    """
    return df.withColumn("_base", clean(F.col(text))).withColumn("_low", F.lower("_base"))


def with_intent_scores(df: DataFrame, tile_id: str | None = None) -> DataFrame:
    """Score of every intent as `s_<intent>`; a selected tile boosts three of them."""
    low = F.col("_low")
    scores = {}
    for name, weight, words, patterns in vocab.INTENTS:
        hit = low.rlike("|".join(f"(?:{p})" for p in patterns))
        s = count_contained("_low", words) * F.lit(weight * 0.5) + F.when(hit, F.lit(weight * 0.7)).otherwise(F.lit(0.0))
        if tile_id is not None and name in vocab.CONTEXT_BOOSTED:
            s = s * F.when(F.col(tile_id) != "", F.lit(vocab.CONTEXT_BOOST)).otherwise(F.lit(1.0))
        scores["s_" + name.lower()] = F.round(s, 6)
    return df.withColumns(scores)


def with_intent(df: DataFrame) -> DataFrame:
    """Highest score, ties to the listed order, search below 0.1."""
    names = [i[0] for i in vocab.INTENTS]
    df = df.withColumn("_top", F.greatest(*["s_" + n.lower() for n in names]))
    out = F.when(F.col("_top") < 0.1, F.lit(vocab.DEFAULT_INTENT))
    for n in names:
        out = out.when(F.col("s_" + n.lower()) == F.col("_top"), F.lit(n))
    return df.withColumn("intent", out).drop("_top")


def region_name(low: str) -> Column:
    """First gazetteer region, in list order, that occurs as whole words in a lower-cased column."""
    whens = " ".join(f"WHEN {low} RLIKE r'\\b{r[0]}\\b' THEN '{r[0]}'" for r in vocab.REGIONS)
    return F.expr(f"CASE {whens} END")


def _table(rows) -> Column:
    return F.create_map(*[F.lit(x) if not isinstance(x, Column) else x for kv in rows for x in kv])


MONTH_FIELDS = ("_m1", "_m2", "_m3")


def with_extracted(df: DataFrame, text: str) -> DataFrame:
    """Place, box, dates, cloud limit and sensor named in the text.

    Month names give whole months; ISO dates override them: two are from and to,
    a single one is the start after "after"/"since", else the end.
    """
    t, low = F.col(text), F.col("_low")
    part = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    # each clause is searched for once, and only where its marker occurs; its parts are then read from the clause
    df = df.withColumns({
        "_region": region_name("_low"),
        "_range": F.when(low.contains("between") | low.contains("from"), F.regexp_extract(low, MONTH_RANGE, 0)),
        "_one": F.when(low.contains("in") | low.contains("during"), F.regexp_extract(low, MONTH_ONE, 0)),
        "_boxed": F.when(t.contains("["), F.regexp_extract(t, BBOX, 0)),
        "_iso": F.when(t.contains("-"), F.regexp_extract_all(t, F.lit(ISO_DATE), 1)).otherwise(F.array().cast("array<string>")),
        "_since": low.contains("after") | low.contains("since"),
        "max_cloud_cover": F.when(low.contains("cloud"), part(low, CLOUD, 1)).cast("double"),
        "sensor": F.when(low.contains("sentinel-2") | low.contains("sentinel 2"), F.lit("Sentinel-2"))
        .when(low.contains("landsat"), F.lit("Landsat-8"))
        .when(low.contains("sar") | low.contains("sentinel-1"), F.lit("Sentinel-1")),
    })
    ranged, one, boxed = F.col("_range"), F.col("_one"), F.col("_boxed")
    df = df.withColumns({
        "_m1": F.regexp_extract(ranged, MONTH_RANGE, 1), "_m2": F.regexp_extract(ranged, MONTH_RANGE, 2),
        "_y1": part(ranged, MONTH_RANGE, 3).cast("int"),
        "_m3": F.regexp_extract(one, MONTH_ONE, 1), "_y3": part(one, MONTH_ONE, 2).cast("int"),
        **{f"_b{i}": part(boxed, BBOX, i).cast("double") for i in (1, 2, 3, 4)},
    })
    months = _table(vocab.MONTHS)
    boxes = _table([(r[0], F.array(*[F.lit(x) for x in r[1:]])) for r in vocab.REGIONS])
    df = df.withColumns({m: F.try_element_at(months, F.col(m)) for m in MONTH_FIELDS}).withColumn(
        "_box", F.try_element_at(boxes, F.col("_region"))
    )
    ranged = F.col("_m1").isNotNull() & F.col("_m2").isNotNull()
    df = df.withColumns({
        "_from": F.make_date(F.when(ranged, F.coalesce("_y1", F.lit(vocab.DEFAULT_YEAR))).otherwise(F.col("_y3")), F.when(ranged, F.col("_m1")).otherwise(F.col("_m3")), F.lit(1)),
        "_to": F.make_date(F.when(ranged, F.coalesce("_y1", F.lit(vocab.DEFAULT_YEAR))).otherwise(F.col("_y3")), F.when(ranged, F.col("_m2")).otherwise(F.col("_m3")), F.lit(1)),
    })
    n, first, second = F.size("_iso"), F.get("_iso", F.lit(0)), F.get("_iso", F.lit(1))
    return df.withColumns({
        "location": F.initcap("_region"),
        **{c: F.coalesce(F.col(f"_b{i + 1}"), F.col("_box")[i]) for i, c in enumerate(("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy"))},
        "date_from": F.when((n >= 2) | ((n == 1) & F.col("_since")), first).otherwise(F.col("_from").cast("string")),
        "date_to": F.when(n >= 2, second).when((n == 1) & ~F.col("_since"), first).otherwise(F.last_day("_to").cast("string")),
    }).drop("_range", "_one", "_boxed", "_m1", "_m2", "_m3", "_y1", "_y3", "_iso", "_since", "_b1", "_b2", "_b3", "_b4", "_box", "_from", "_to")


def with_prompt(df: DataFrame) -> DataFrame:
    """The text without date, cloud, box and place clauses and leading verb; the text itself if under 4 characters remain."""
    p = F.col("_base")
    for pattern in STRIP_CLAUSES:
        p = F.regexp_replace(p, pattern, "")
    df = df.withColumn("_p", p)
    region = F.col("_region")
    place_clause, place = (F.concat(F.lit(a), region, F.lit(b)) for a, b in (vocab.PLACE_CLAUSE, vocab.PLACE_ALONE))
    df = df.withColumn("_p", F.when(region.isNotNull(), F.regexp_replace(F.regexp_replace("_p", place_clause, F.lit("")), place, F.lit(""))).otherwise(F.col("_p")))
    df = df.withColumn("_p", F.btrim(F.regexp_replace(F.regexp_replace("_p", LEADING_VERB, ""), r"\s+", " "), F.lit(" ,.-")))
    return df.withColumn("cleaned_prompt", F.when(F.length("_p") < 4, F.col("_base")).otherwise(F.col("_p"))).drop("_p")


def parse_queries(df: DataFrame, text: str = "text", tile_id: str | None = None) -> DataFrame:
    """Add every extracted field to a query table."""
    df = with_intent(with_intent_scores(with_lowered(df, text), tile_id))
    df = df.withColumn("is_change_query", (F.col("intent") == "CHANGE_ANALYSIS") | F.col("_low").rlike("|".join(vocab.CHANGE_WORDS)))
    df = with_prompt(with_extracted(df, text)).withColumn("confidence", F.lit(vocab.CLASSIFIER_CONFIDENCE))
    return df.drop("_base", "_low", "_region", *["s_" + i[0].lower() for i in vocab.INTENTS])


def explicit_over_extracted(df: DataFrame, explicit: dict[str, str]) -> DataFrame:
    """Given parameters win over those read from the text: {extracted column: explicit column}."""
    return df.withColumns({k: F.coalesce(F.col(v), F.col(k)) for k, v in explicit.items()})

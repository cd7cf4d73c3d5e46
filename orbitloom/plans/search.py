"""Semantic search of many query texts in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.querytext import explicit_over_extracted, parse_queries
from ..operators import knn, pruned, rerank as R
from ..operators.embedding import Encoder, encode_prompts
from ..session import materialize

FILTERS = ["bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "date_from", "date_to", "sensor"]


def parsed_requests(queries: DataFrame, explicit: dict[str, str] | None = None) -> DataFrame:
    """Queries (query_id, text) with extracted fields and the id of the search they ask for.

    Equal searches share a request id, so a text asked by a third of all users is scored once.
    """
    parsed = parse_queries(queries)
    if explicit:
        parsed = explicit_over_extracted(parsed, explicit)
    key = F.concat_ws("|", "cleaned_prompt", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in FILTERS])
    return parsed.withColumn("request_id", F.md5(key))


def with_search(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """`requests` with first_day, last_day and the search_id of the requests that the same tiles pass.

    A limit on dates that falls between two days of `scenes` is as good as the next of these days, and a request that no
    day passes is left out.  Both sides of the comparison are distinct days.
    """
    day = scenes.select(F.col("acquisition_date").cast("string").alias("day")).where("day <> ''").distinct()
    limit = lambda c: requests.select(c).where(F.col(c) != "").distinct()
    first = limit("date_from").join(day, F.col("day") >= F.col("date_from")).groupBy("date_from").agg(F.min("day").alias("first_day"))
    last = limit("date_to").join(day, F.col("day") <= F.col("date_to")).groupBy("date_to").agg(F.max("day").alias("last_day"))
    asks = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    found = requests.join(first, "date_from", "left").join(last, "date_to", "left").where(
        (~asks("date_from") | F.col("first_day").isNotNull()) & (~asks("date_to") | F.col("last_day").isNotNull()))
    key = [*FILTERS[:4], "first_day", "last_day", F.nullif(F.lower("sensor"), F.lit(""))]
    return found.withColumn("search_id", F.md5(F.concat_ws("|", "cleaned_prompt", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in key])))


def semantic_search(queries: DataFrame, tiles: DataFrame, scenes: DataFrame, encoder: Encoder, k: int = 20,
                    explicit: dict[str, str] | None = None) -> DataFrame:
    """Top-k reranked tiles per query: parse, encode, filter and score in blocks, rerank, graduate, attach metadata.

    Equal texts are parsed once, and requests that the same tiles pass are searched once; queries meet their results last.
    """
    given = ["text", *dict.fromkeys((explicit or {}).values())]
    parsed = parsed_requests(queries.select(*given).distinct(), explicit).select(*given, "intent", "cleaned_prompt", *FILTERS)
    parsed = materialize(with_search(materialize(parsed, "parsed"), scenes), "searches")
    searches = parsed.groupBy("search_id").agg(
        *[F.first(c).alias(c) for c in ("cleaned_prompt", *FILTERS[:4])], F.first("first_day").alias("date_from"), F.first("last_day").alias("date_to"),
        F.first("sensor").alias("sensor"))
    prompts = encode_prompts(searches.select("cleaned_prompt").distinct(), "cleaned_prompt", encoder)
    prompts = prompts.withColumn("domains", R.query_domains(F.col("cleaned_prompt")))
    asked = materialize(searches.join(prompts, "cleaned_prompt").withColumnRenamed("search_id", "query_id"), "requests")
    facts = tiles.join(scenes.select("scene_id", "sensor", "acquisition_date"), "scene_id")
    hits = R.search_blocks(facts, asked, k, encoder.dim)
    names = R.with_tile_rules(facts.drop("embedding"))
    args = [F.col(c) for c in ("domains", "confirms", "contradicts")]
    scored = (
        hits.join(names, "tile_id").join(asked.select("query_id", "domains"), "query_id")
        .withColumn("is_strongly_aligned", R.aligned(F.col("verified"), *args))
        .withColumn("vlm_reasoning", R.reason(F.col("verified"), *args))
    )
    done = materialize(R.graduate(scored).select(
        F.col("query_id").alias("search_id"), "tile_id", "scene_id", "rank", "similarity", "raw_similarity", "match_percentage",
        "vlm_reasoning", "is_strongly_aligned", F.col("sensor").alias("tile_sensor"), F.col("acquisition_date").cast("string").alias("date"),
    ), "results")
    texts = parsed.select(*[F.col(c).alias(f"_{c}") for c in given], "intent", "cleaned_prompt", "search_id")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in given])
    return queries.select("query_id", *given).join(texts, same).select("query_id", "intent", "cleaned_prompt", "search_id").join(done, "search_id").drop("search_id")


def similarity_search(tile_ids: DataFrame, tiles: DataFrame, scenes: DataFrame, k: int = 20, **filters) -> DataFrame:
    """Tile-to-tile search: metadata filters first, then exact k, calibrated scores."""
    from ..operators.filters import metadata_filter

    facts = tiles.join(scenes.select("scene_id", "sensor", "acquisition_date"), "scene_id")
    base = metadata_filter(facts, **filters)
    queries = tiles.join(tile_ids.select("tile_id").distinct(), "tile_id", "left_semi").select(F.col("tile_id").alias("query_id"), "embedding")
    hits = pruned.nearest(base, queries, k, exclude_self=True)
    return knn.with_tile_metadata(hits, tiles, scenes, "image")

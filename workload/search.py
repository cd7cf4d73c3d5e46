"""Query texts, vectors, search and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitloom.functions import querytext as Q, vector as V
from orbitloom.operators import embedding as E, knn, pruned, quantised, rerank as R
from orbitloom.operators.ranking import one_row
from orbitloom.plans import search as P
from orbitloom.session import materialize

from . import duck_views as dv, views as v
from .registry import query

DIM = 64
BOX = ("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy")


def _vectors(spark, d):
    return v.tiles(spark, d).select("tile_id", "embedding")


def _as_queries(spark, d):
    return v.tiles(spark, d).select(F.col("tile_id").alias("query_id"), "embedding")


# ---- query text

@query("Q1 Q2 Q3", """
SELECT query_id, s_provenance, s_change_analysis, s_image_similarity, s_vqa, s_semantic_search, intent FROM v_regions""")
def query_intents(spark, d):
    scored = Q.with_intent(Q.with_intent_scores(Q.with_lowered(v.queries(spark, d), "text"), "tile_id"))
    return scored.select("query_id", *[c for c in scored.columns if c.startswith("s_")], "intent")


@query("Q4 Q5 Q6 Q7 Q8 Q9 Q10 Q11 Q12 J7", """
SELECT query_id, intent, is_change_query, location, bbox_minx, bbox_miny, bbox_maxx, bbox_maxy, date_from, date_to, max_cloud_cover, sensor, cleaned_prompt,
  0.92::DOUBLE AS confidence FROM v_parsed""")
def query_parse(spark, d):
    return Q.parse_queries(v.queries(spark, d), "text", "tile_id").select(
        "query_id", "intent", "is_change_query", "location", *BOX, "date_from", "date_to", "max_cloud_cover", "sensor", "cleaned_prompt", "confidence"
    )


@query("Q13", "SELECT query_id, sensor, date_from FROM v_searches")
def explicit_parameters(spark, d):
    parsed = Q.parse_queries(v.queries(spark, d))
    return Q.explicit_over_extracted(parsed, {"sensor": "sensor_given"}).select("query_id", "sensor", "date_from")


@query("K1 J8", """SELECT cleaned_prompt, domains FROM v_prompt_domains""")
def query_domains(spark, d):
    parsed = Q.parse_queries(v.queries(spark, d)).select("cleaned_prompt").distinct()
    return parsed.select("cleaned_prompt", R.query_domains(F.col("cleaned_prompt")).alias("domains"))


# ---- vectors

@query("V1", """
SELECT tile_id, (i - 1)::INT AS slot, round(embedding[i] / sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) + 0.0::DOUBLE AS value
FROM (SELECT *, unnest(range(1, 65)) AS i FROM v_tiles)""")
def unit_vectors(spark, d):
    u = v.tiles(spark, d).select("tile_id", F.posexplode(V.unit(F.col("embedding"))).alias("slot", "value"))
    return u.select("tile_id", "slot", (F.round("value", 6) + 0.0).alias("value"))


@query("V2 V3 L5", """
SELECT a.tile_id AS query_id, b.tile_id, round(list_dot_product(a.embedding, b.embedding), 6) AS score,
  row_number() OVER (PARTITION BY a.tile_id ORDER BY round(list_dot_product(a.embedding, b.embedding), 6) DESC, b.tile_id) AS rank
FROM v_tiles a, v_tiles b QUALIFY rank <= 10""")
def nearest_tiles(spark, d):
    hits = pruned.nearest(_vectors(spark, d), _as_queries(spark, d), 10)
    return hits.select("query_id", "tile_id", F.round("score", 6).alias("score"), "rank")


@query("V3 L5", """
SELECT count(*) AS queries, true AS every_row_in_a_block, true AS at_most_all_pairs FROM v_tiles WHERE vec_id % 20 = 0""")
def scored_pairs(spark, d):
    """How much of the archive an exact search looks at: every row is in a block, and no pair of query and block is scored twice."""
    index = pruned.build(_vectors(spark, d))
    share = pruned.scored_share(index, _twentieth(spark, d), 10)
    rows = one_row(share, _vectors(spark, d).agg(F.count("*").alias("held")))
    return rows.select(
        "queries", (F.col("held") == int(index.blocks.size.sum())).alias("every_row_in_a_block"), (F.col("scored") <= F.col("pairs")).alias("at_most_all_pairs"))


@query("V3 L5", """
SELECT tile_id, round(list_dot_product(embedding, list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END)), 6) AS score
FROM v_tiles ORDER BY score DESC, tile_id LIMIT 20""")
def nearest_to_literal(spark, d):
    return knn.nearest_one(_vectors(spark, d), [0.125 if i % 2 == 0 else -0.125 for i in range(DIM)], 20)


@query("V4 F11 L6 V9 V10 J3 F5", f"""
SELECT query_id, tile_id, rank, round(0.5 + 0.48::DOUBLE * least(greatest((score - 0.45) / 0.5, 0.0), 1.0), 4) AS similarity, round(score, 4) AS raw_similarity,
  {dv.pct("round(0.5 + 0.48::DOUBLE * least(greatest((score - 0.45) / 0.5, 0.0), 1.0), 4)")} AS match_percentage, sensor
FROM (SELECT a.tile_id AS query_id, b.tile_id, list_dot_product(a.embedding, b.embedding) AS score, s.sensor,
  row_number() OVER (PARTITION BY a.tile_id ORDER BY round(list_dot_product(a.embedding, b.embedding), 6) DESC, b.tile_id) AS rank
  FROM v_tiles a, v_tiles b JOIN v_scenes s ON b.scene_id = s.scene_id
  WHERE a.tile_id <> b.tile_id AND s.acquisition_date >= DATE '2024-03-01' AND lower(s.sensor) <> 'none'
    AND b.bounds_maxx >= 91.6 AND b.bounds_minx <= 91.9 AND b.bounds_maxy >= 26.0 AND b.bounds_miny <= 26.4 QUALIFY rank <= 20)""")
def similar_tiles(spark, d):
    t = v.tiles(spark, d)
    hits = P.similarity_search(t, t, v.scenes(spark, d), 20, bbox=[91.6, 26.0, 91.9, 26.4], date_from="2024-03-01")
    return hits.select("query_id", "tile_id", "rank", "similarity", "raw_similarity", "match_percentage", "sensor")


@query("V8", """
SELECT event_id, round(least(greatest(0.5::DOUBLE + 0.48::DOUBLE * pow(least(greatest((value / 500.0::DOUBLE - 0.15) / 0.18, 0.0), 1.0), 0.85), 0.10), 0.99), 4) AS confidence FROM events""")
def text_calibration(spark, d):
    return v.table(spark, d, "events").select("event_id", V.text_confidence(F.col("value") / 500.0).alias("confidence"))


@query("V5 V6 V7", "SELECT cleaned_prompt, slot::INT AS slot, round(w, 6) AS w FROM v_prompt_vectors WHERE round(w, 6) <> 0")
def prompt_vectors(spark, d):
    prompts = Q.parse_queries(v.queries(spark, d)).select("cleaned_prompt").distinct()
    vec = E.encode_prompts(prompts, "cleaned_prompt", E.HashingEncoder(DIM))
    return vec.select("cleaned_prompt", F.posexplode("embedding").alias("slot", "w")).select(
        "cleaned_prompt", "slot", F.round("w", 6).alias("w")
    ).where("w <> 0")


@query("V7", """
WITH words AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
slots AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot,
  sum(CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM words WHERE word <> '' GROUP BY 1, 2)
SELECT doc_id, slot::INT AS slot, round((w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS w FROM slots WHERE w <> 0""")
def document_vectors(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    vec = E.encode_texts(docs, "text", E.HashingEncoder(DIM)).select("doc_id", F.posexplode("embedding").alias("slot", "w"))
    return vec.where("w <> 0").select("doc_id", "slot", F.round(F.col("w").cast("double"), 4).alias("w"))


@query("V12 J12", """
SELECT tile_id, content_hash FROM v_current WHERE tile_id NOT IN (SELECT tile_id FROM v_manifest WHERE embedding_model = 'hashing-words')""")
def tiles_not_indexed(spark, d):
    from orbitloom.operators.incremental import not_indexed

    have = v.manifest(spark, d).select("tile_id", F.col("embedding_model").alias("model_name"))
    return not_indexed(v.current_tiles(spark, d), have, "hashing-words").select("tile_id", "content_hash")


_EXACT = """
SELECT a.tile_id AS query_id, b.tile_id, round(list_dot_product(a.embedding, b.embedding), 6) AS score,
  row_number() OVER (PARTITION BY a.tile_id ORDER BY round(list_dot_product(a.embedding, b.embedding), 6) DESC, b.tile_id) AS rank
FROM v_tiles a, v_tiles b QUALIFY rank <= 10"""


@query("V13", _EXACT)
def neighbours_of_all_cells(spark, d):
    """The cell index with as many probes as cells: it has to give the exact answer."""
    hits = knn.nearest_by_cells(_vectors(spark, d), _as_queries(spark, d), 10, DIM, cells=knn.CELLS, probes=knn.CELLS)
    return hits.select("query_id", "tile_id", F.round("score", 6).alias("score"), "rank")


def _twentieth(spark, d):
    return v.tiles(spark, d).where("vec_id % 20 = 0").select(F.col("tile_id").alias("query_id"), "embedding")


@query("V13", f"""SELECT count(*) AS hits, true AS recall_reached, true AS every_row_coded, true AS a_fifth_at_most
FROM ({_EXACT})""")
def neighbour_recall(spark, d):
    """The compressed index of `approximate_neighbours` against the exact search, for every tile as a query: whether at least 0.9 of the
    exact neighbours are found, every row has a code, and a query reads at most a fifth of the rows as full vectors."""
    base, asked = _vectors(spark, d), _as_queries(spark, d)
    index = quantised.build(base)
    exact = pruned.nearest(base, asked, 10).select("query_id", "tile_id")
    listed = materialize(quantised.shortlist(index, asked, quantised.SHORTLIST), "listed")
    # a tile that comes twice is listed twice, and must not count an exact neighbour twice
    near = quantised.nearest(index, asked, 10, listed=listed).select("query_id", "tile_id", F.lit(1).alias("found")).distinct()
    read = listed.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    met = exact.join(near, ["query_id", "tile_id"], "left").agg(F.count("*").alias("hits"), F.count("found").alias("found"))
    rows = one_row(met, read, base.agg(F.count("*").alias("held")), index.codes.agg(F.count("*").alias("coded")))
    return rows.select("hits", (F.col("found") >= 0.9 * F.col("hits")).alias("recall_reached"), (F.col("held") == F.col("coded")).alias("every_row_coded"),
                       (5 * F.col("most") <= F.col("held")).alias("a_fifth_at_most"))


@query("V13")
def approximate_neighbours(spark, d):
    """Ten neighbours of every twentieth tile among all tiles, by compressed vectors and an exact rerank."""
    hits = quantised.nearest(quantised.build(_vectors(spark, d)), _twentieth(spark, d), 10)
    return hits.select("query_id", "tile_id", F.round("score", 6).alias("score"), "rank")


# ---- rerank and full search

_CAND = """
SELECT * FROM (SELECT q.cleaned_prompt, t.*, q.score, round(q.score, 4) AS raw, p.domains FROM v_prompt_scores q JOIN v_rule_tiles t USING (tile_id) JOIN v_prompt_domains p USING (cleaned_prompt))"""


@query("K2 K3 K4 L7 W5", f"""
WITH scored AS (SELECT *, {dv.VERIFIED} AS verified FROM ({_CAND})),
ranked AS (SELECT *, {dv.ALIGNED} AS al, row_number() OVER (PARTITION BY cleaned_prompt ORDER BY verified DESC, raw DESC, tile_id) AS rank FROM scored QUALIFY rank <= 20),
topped AS (SELECT *, first_value(al) OVER (PARTITION BY cleaned_prompt ORDER BY rank) AS top FROM ranked),
done AS (SELECT *, CASE WHEN top AND al THEN round(greatest(0.85::DOUBLE, 0.965::DOUBLE - (rank - 1) * 0.022::DOUBLE + code % 10 * 0.002::DOUBLE), 4) ELSE verified END AS similarity FROM topped)
SELECT cleaned_prompt AS query_id, tile_id, rank, raw AS raw_similarity, similarity, {dv.pct("similarity")} AS match_percentage, al AS is_strongly_aligned, {dv.REASON} AS vlm_reasoning FROM done""")
def reranked_prompts(spark, d):
    """Distinct prompts against the whole archive, no filters."""
    enc = E.HashingEncoder(DIM)
    prompts = Q.parse_queries(v.queries(spark, d)).select("cleaned_prompt").distinct()
    none = F.lit(None)
    asked = E.encode_prompts(prompts, "cleaned_prompt", enc).select(
        F.col("cleaned_prompt").alias("query_id"), "embedding", R.query_domains(F.col("cleaned_prompt")).alias("domains"),
        *[none.cast("double").alias(c) for c in BOX], *[none.cast("string").alias(c) for c in ("date_from", "date_to", "sensor")],
    )
    facts = v.tiles(spark, d).join(v.scenes(spark, d), "scene_id")
    hits = R.search_blocks(facts, asked, 20, DIM)
    args = [F.col(c) for c in ("domains", "confirms", "contradicts")]
    scored = hits.join(R.with_tile_rules(facts.select("tile_id", "scene_id")), "tile_id").join(asked.select("query_id", "domains"), "query_id")
    scored = scored.withColumn("is_strongly_aligned", R.aligned(F.col("verified"), *args)).withColumn("vlm_reasoning", R.reason(F.col("verified"), *args))
    return R.graduate(scored).select("query_id", "tile_id", "rank", "raw_similarity", "similarity", "match_percentage", "is_strongly_aligned", "vlm_reasoning")


@query("K5 E8 J3 L6 Q13", f"""
WITH asked AS (SELECT DISTINCT * EXCLUDE (query_id) FROM v_searches),
cand AS (SELECT c.*, a.bbox_minx, a.bbox_miny, a.bbox_maxx, a.bbox_maxy, a.date_from, a.date_to, a.sensor AS asked_sensor FROM asked a JOIN ({_CAND}) c ON a.cleaned_prompt = c.cleaned_prompt
  WHERE (a.bbox_minx IS NULL OR (c.bounds_maxx >= a.bbox_minx AND c.bounds_minx <= a.bbox_maxx AND c.bounds_maxy >= a.bbox_miny AND c.bounds_miny <= a.bbox_maxy))
    AND (a.date_from IS NULL OR c.acquisition_date::VARCHAR >= a.date_from) AND (a.date_to IS NULL OR c.acquisition_date::VARCHAR <= a.date_to)
    AND (a.sensor IS NULL OR lower(c.sensor) = lower(a.sensor))),
scored AS (SELECT *, {dv.VERIFIED} AS verified FROM cand),
ranked AS (SELECT *, {dv.ALIGNED} AS al, row_number() OVER (PARTITION BY cleaned_prompt, bbox_minx, bbox_miny, date_from, date_to, asked_sensor ORDER BY verified DESC, raw DESC, tile_id) AS rank FROM scored QUALIFY rank <= 20),
topped AS (SELECT *, first_value(al) OVER (PARTITION BY cleaned_prompt, bbox_minx, bbox_miny, date_from, date_to, asked_sensor ORDER BY rank) AS top FROM ranked),
done AS (SELECT *, CASE WHEN top AND al THEN round(greatest(0.85::DOUBLE, 0.965::DOUBLE - (rank - 1) * 0.022::DOUBLE + code % 10 * 0.002::DOUBLE), 4) ELSE verified END AS similarity FROM topped)
SELECT s.query_id, r.tile_id, r.rank, r.raw AS raw_similarity, r.similarity, r.al AS is_strongly_aligned, r.sensor AS tile_sensor, r.acquisition_date::VARCHAR AS date
FROM v_searches s JOIN done r ON s.cleaned_prompt = r.cleaned_prompt AND s.bbox_minx IS NOT DISTINCT FROM r.bbox_minx AND s.bbox_miny IS NOT DISTINCT FROM r.bbox_miny
  AND s.date_from IS NOT DISTINCT FROM r.date_from AND s.date_to IS NOT DISTINCT FROM r.date_to AND s.sensor IS NOT DISTINCT FROM r.asked_sensor""")
def semantic_search(spark, d):
    hits = P.semantic_search(
        v.queries(spark, d).select("query_id", "text", "sensor_given"), v.tiles(spark, d), v.scenes(spark, d),
        E.HashingEncoder(DIM), 20, {"sensor": "sensor_given"},
    )
    return hits.select("query_id", "tile_id", "rank", "raw_similarity", "similarity", "is_strongly_aligned", "tile_sensor", "date")


@query("S13 V12", "SELECT tile_id, (i - 1)::INT AS slot, round(embedding[i]::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM v_tiles)")
def stored_vectors(spark, d):
    """The vector table saved and loaded again."""
    from orbitloom.session import new_table_path
    from orbitloom.sources import tables as S

    path = new_table_path(spark, "vectors")
    S.save_vectors(v.tiles(spark, d), path)
    loaded = S.load_vectors(spark, path).select("tile_id", F.posexplode("embedding").alias("slot", "value"))
    return loaded.select("tile_id", "slot", (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


# ---- vocabularies as dictionary tables

@query("J7 Q4", "SELECT query_id, location FROM v_parsed")
def dictionary_regions(spark, d):
    """The gazetteer as a table: the same places as by one pattern per name."""
    from orbitloom import vocab
    from orbitloom.operators.dictionary import first_entry

    regions = spark.createDataFrame([(r[0], i) for i, r in enumerate(vocab.REGIONS)], "name string, place int")
    texts = v.queries(spark, d).select("query_id", F.lower(Q.clean(F.col("text"))).alias("low"))
    return first_entry(texts, "low", regions, "name", "place").select("query_id", F.initcap("entry").alias("location"))


@query("J8 K1", "SELECT cleaned_prompt, domains FROM v_prompt_domains")
def dictionary_domains(spark, d):
    """Domain keywords as a table: the bits of all domains whose keywords a prompt holds."""
    from orbitloom import vocab
    from orbitloom.operators.dictionary import labels_of

    words = spark.createDataFrame([(w, 1 << i) for i, x in enumerate(vocab.DOMAINS) for w in x[1]], "word string, bit int")
    parsed = Q.parse_queries(v.queries(spark, d)).select("cleaned_prompt").distinct()
    prompts = materialize(parsed.withColumn("low", F.lower("cleaned_prompt")), "prompts")
    bits = labels_of(prompts, "low", words, "word", "bit").groupBy(F.col("text").alias("low")).agg(F.sum("label").cast("int").alias("domains"))
    return prompts.join(bits, "low", "left").select("cleaned_prompt", F.coalesce("domains", F.lit(0)).alias("domains"))


@query("J7", """
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS entry FROM benchmark)
SELECT doc_id, count(entry) AS held, coalesce(sum(length(entry)), 0)::BIGINT AS letters FROM documents LEFT JOIN words ON contains(lower(text), entry) GROUP BY 1""")
def benchmark_words_in_documents(spark, d):
    """A dictionary drawn from one table, looked up in all texts of another."""
    from orbitloom.operators.dictionary import held_entries

    words = v.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("entry"))
    docs = v.table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    letters = F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + F.char_length(e))
    hits = held_entries(docs, "low", words, "entry").select("text", F.size("entries").cast("long").alias("held"), letters.alias("letters"))
    return docs.join(hits, docs["low"] == hits["text"], "left").select(
        "doc_id", F.coalesce("held", F.lit(0)).cast("long").alias("held"), F.coalesce("letters", F.lit(0)).cast("long").alias("letters"))

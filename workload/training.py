"""Training pairs, evaluation, incremental indexing, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitloom.operators import evaluate as EV, incremental as I, pruned, pairs as PR
from orbitloom.operators.embedding import HashingEncoder
from orbitloom.sources import tables as S
from orbitloom.streaming import incremental as ST

from . import pixels, views as v  # noqa: F401  (pixels first: its statement of change_analyses is used here)
from .registry import ORACLES, query

DIM = 64


# ---- pairs

@query("T1", "SELECT tile_id, class, score FROM v_cover")
def land_cover_scores(spark, d):
    return PR.land_cover_scores(v.index_values(spark, d)).select("tile_id", F.explode("land_covers").alias("c")).select("tile_id", "c.class", "c.score")


@query("T1 T2", "SELECT tile_id, main, second, phrase FROM v_main_cover")
def land_cover_phrases(spark, d):
    df = PR.land_cover_scores(v.index_values(spark, d))
    return df.select("tile_id", F.col("land_covers")[0]["class"].alias("main"), F.get("land_covers", F.lit(1))["class"].alias("second"), PR.spectral_phrase().alias("phrase"))


@query("T3 J10", "SELECT tile_id, caption FROM v_captions")
def tile_captions(spark, d):
    return PR.captions(PR.land_cover_scores(v.index_values(spark, d)), 5, 42).select("tile_id", "caption")


@query("T4 U3", "SELECT tile_id, caption FROM v_negatives")
def hard_negatives(spark, d):
    return PR.hard_negatives(PR.land_cover_scores(v.index_values(spark, d)), 3, 42).select("tile_id", "caption")


@query("T6 J10", "SELECT tile_id, caption FROM v_curated")
def curated_pairs(spark, d):
    return PR.curated(PR.land_cover_scores(v.index_values(spark, d))).select("tile_id", "caption")


def _training(spark, d):
    return PR.training_pairs(v.index_values(spark, d), 5, 3, 42)


@query("T5 T7 U1", "SELECT tile_id, scene_id, caption, label, land_cover, ndvi, source, split FROM v_split")
def training_split(spark, d):
    return PR.split_by_tile(_training(spark, d), 0.15, 42, tiles=v.index_values(spark, d)).select("tile_id", "scene_id", "caption", "label", "land_cover", "ndvi", "source", "split")


@query("T7 A6", """
SELECT CASE WHEN rank <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split, count(*) AS total_pairs, count(*) FILTER (label = 1) AS positive_pairs, count(*) FILTER (label = 0) AS negative_pairs, count(DISTINCT tile_id) AS unique_tiles
FROM v_pairs JOIN (SELECT tile_id, row_number() OVER (ORDER BY md5(tile_id || '|42'), tile_id) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT tile_id FROM v_pairs)) USING (tile_id) GROUP BY 1""")
def split_summary(spark, d):
    return S.split_summary(PR.split_by_tile(v.caption_pairs(spark, d), 0.15, 42))


@query("S6", """
SELECT CASE WHEN rank <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split, tile_id, label::BIGINT AS label
FROM v_pairs JOIN (SELECT tile_id, row_number() OVER (ORDER BY md5(tile_id || '|42'), tile_id) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT tile_id FROM v_pairs)) USING (tile_id)""")
def pair_files(spark, d):
    """Split pairs written as JSON by split, and read back."""
    from orbitloom.session import new_table_path

    folder = new_table_path(spark, "pairs")
    S.write_pairs(PR.split_by_tile(v.caption_pairs(spark, d), 0.15, 42), folder)
    return spark.read.schema("tile_id STRING, label BIGINT, split STRING").json(f"{folder}/pairs").select("split", "tile_id", "label")


@query("T8", """
SELECT tile_id, CASE WHEN row_number() OVER (ORDER BY md5(tile_id || '|7'), tile_id) <= greatest(100, floor((SELECT count(*) FROM v_pairs) * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM v_pairs""")
def row_split(spark, d):
    return PR.split_by_row(v.caption_pairs(spark, d), ["tile_id"], 0.15, 7, at_least=100).select("tile_id", "split")


_DOCSPLIT = "SELECT *, CASE WHEN tile_id::BIGINT % 7 = 0 THEN 'val' ELSE 'train' END AS split, regexp_replace(caption, '^\\s+|\\s+$', '', 'g') AS c FROM v_pairs"


def _doc_split(spark, d):
    return v.caption_pairs(spark, d).withColumn("split", F.when(F.col("tile_id").cast("bigint") % 7 == 0, "val").otherwise("train"))


@query("A4 T11", f"SELECT split, coalesce(land_cover, 'unknown') AS land_cover, count(*) AS pairs FROM ({_DOCSPLIT}) GROUP BY 1, 2")
def class_distribution(spark, d):
    return PR.class_distribution(_doc_split(spark, d))


@query("A5 T11", f"""
SELECT split, count(*) AS total, round(avg(n), 1) AS mean, min(n) AS min, max(n) AS max FROM (SELECT split, CASE WHEN c = '' THEN 0 ELSE len(regexp_split_to_array(c, '\\s+')) END AS n FROM ({_DOCSPLIT})) GROUP BY 1""")
def caption_lengths(spark, d):
    return PR.caption_lengths(_doc_split(spark, d)).select("split", "total", "mean", F.col("min").cast("bigint").alias("min"), F.col("max").cast("bigint").alias("max"))


@query("A7", """
SELECT tile_id, ((position - 1) // 500)::INT AS part, string_agg(caption, ';' ORDER BY position) AS captions FROM (
  SELECT c_mktsegment AS tile_id, o_orderkey::VARCHAR AS caption,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(o_orderkey::VARCHAR), 1, 3), o_orderkey::VARCHAR) AS position
  FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2""")
def captions_by_tile(spark, d):
    rows = v.observations(spark, d).select(F.col("sensor").alias("tile_id"), F.col("obs_id").cast("string").alias("caption"))
    return PR.captions_by_tile(rows).select("tile_id", "part", F.array_join("captions", ";").alias("captions"))


@query("A8", "SELECT DISTINCT caption FROM v_pairs")
def distinct_captions(spark, d):
    return PR.distinct_captions(v.caption_pairs(spark, d))


@query("T9 L8", """
SELECT path, class_name, caption FROM (SELECT * FROM v_class_files QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY md5(path || '|42'), path) <= 60) JOIN v_class_captions USING (class_name)""")
def class_captions(spark, d):
    return PR.class_captions(PR.sample_per_class(v.class_files(spark, d), 60, 42)).select("path", "class_name", "caption")


@query("T10 J9", """
SELECT tile_id, category AS domain_category, caption, CASE WHEN contains(tile_id, '_tile_') THEN split_part(tile_id, '_tile_', 1) ELSE tile_id END AS scene_id FROM v_tile_categories JOIN v_taxonomy USING (category)""")
def category_queries(spark, d):
    return PR.category_queries(v.named_tiles(spark, d)).select("tile_id", "domain_category", "caption", "scene_id")


@query("S7", """
SELECT page_id AS image_no, s AS caption, CASE WHEN coalesce(CASE page_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END, 'train') = 'train' THEN 'train' ELSE 'val' END AS split
FROM (SELECT page_id, unnest(list_filter(string_split(url, '/'), lambda x: x <> '')[1:3]) AS s FROM pages)""")
def flattened_captions(spark, d):
    p = v.table(spark, d, "pages")
    images = p.select(
        F.col("page_id").alias("image_no"), F.col("page_id").cast("string").alias("filename"),
        F.when(F.col("page_id") % 3 == 0, "train").when(F.col("page_id") % 3 == 1, "test").alias("split"),
        F.transform(F.split("url", "/"), lambda x: F.struct(x.alias("raw"))).alias("sentences"),
    )
    return S.flatten_captions(images).select(F.col("image_path").cast("bigint").alias("image_no"), "caption", "split")


@query("S5", "SELECT tile_id, land_cover FROM (SELECT *, CASE WHEN tile_id::BIGINT % 6 = 5 THEN 0 WHEN tile_id::BIGINT % 6 = 4 THEN NULL ELSE 1 END AS l FROM v_pairs) WHERE coalesce(l, 1) = 1")
def pair_manifest_roundtrip(spark, d):
    """Pairs written as manifest files and read back, positives only; a missing label counts as 1."""
    from orbitloom.session import new_table_path

    p = v.caption_pairs(spark, d)
    k = F.col("tile_id").cast("bigint") % 6
    pair = F.struct("tile_id", "caption", "land_cover", F.when(k == 5, 0).when(k != 4, 1).alias("label"))
    path = new_table_path(spark, "pairs")
    p.select(F.array(pair).alias("pairs")).write.json(path)
    return S.read_pairs(spark, path, one_document=False).select("tile_id", "land_cover")


# ---- evaluation

_HITS = """SELECT a.tile_id AS query_id, b.tile_id, a.label = b.label AS relevant, a.label AS ql,
  row_number() OVER (PARTITION BY a.tile_id ORDER BY round(list_dot_product(a.embedding, b.embedding), 6) DESC, b.tile_id) AS rank FROM v_tiles a JOIN v_tiles b ON a.tile_id <> b.tile_id QUALIFY rank <= 20"""
_PERQ = f"""
WITH hits AS ({_HITS}), sizes AS (SELECT label, count(*) - 1 AS n FROM v_tiles GROUP BY 1),
perq AS (SELECT query_id, max(n) AS relevant_count, count(*) AS total_retrieved, count(*) FILTER (relevant AND rank <= 1) / least(1, max(n))::DOUBLE AS recall_1, count(*) FILTER (relevant AND rank <= 5) / least(5, max(n))::DOUBLE AS recall_5,
  count(*) FILTER (relevant AND rank <= 10) / least(10, max(n))::DOUBLE AS recall_10, count(*) FILTER (relevant AND rank <= 5) / 5.0::DOUBLE AS precision_5, coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0.0) AS reciprocal_rank,
  string_agg(CASE WHEN rank <= 3 THEN tile_id END, ',' ORDER BY rank) AS top_3 FROM hits JOIN sizes ON ql = label GROUP BY 1)"""


def _per_query(spark, d):
    t = v.tiles(spark, d).select("tile_id", "embedding", "label")
    q = t.select(F.col("tile_id").alias("query_id"), "embedding")
    hits = pruned.nearest(t, q, 20, exclude_self=True)
    labels = t.select("tile_id", "label")
    judged = hits.join(labels, "tile_id").join(labels.select(F.col("tile_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("relevant", F.col("label") == F.col("ql"))
    sizes = labels.join(labels.groupBy("label").agg((F.count("*") - 1).alias("relevant_count")), "label").select(F.col("tile_id").alias("query_id"), "relevant_count")
    return EV.per_query_metrics(judged, sizes)


@query("E1 E2 E3 E4 W4 U2", _PERQ + " SELECT query_id, relevant_count, total_retrieved, round(recall_1, 4) AS recall_1, round(recall_5, 4) AS recall_5, round(recall_10, 4) AS recall_10, round(precision_5, 4) AS precision_5, round(reciprocal_rank, 4) AS reciprocal_rank, top_3 FROM perq")
def retrieval_metrics(spark, d):
    m = _per_query(spark, d)
    return m.select("query_id", "relevant_count", "total_retrieved", "top_3", *[F.round(c, 4).alias(c) for c in ("recall_1", "recall_5", "recall_10", "precision_5", "reciprocal_rank")])


_REPORT = _PERQ + " SELECT count(*) AS queries, round(avg(recall_1), 4) AS mean_recall_1, round(avg(recall_5), 4) AS mean_recall_5, round(avg(recall_10), 4) AS mean_recall_10, round(avg(precision_5), 4) AS mean_precision_5, round(avg(reciprocal_rank), 4) AS mrr FROM perq"


@query("A10 E3", _REPORT)
def retrieval_report(spark, d):
    return EV.metric_means(_per_query(spark, d))


@query("S9", _REPORT)
def report_file(spark, d):
    """The retrieval report written as JSON and read back."""
    from orbitloom.session import new_table_path

    report = EV.metric_means(_per_query(spark, d))
    path = new_table_path(spark, "report")
    S.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


_TEXTV = """
texts AS (SELECT a.vec_id, a.embedding AS image, list_transform(range(64), lambda i: a.embedding[i + 1] * 0.6::DOUBLE + coalesce(b.embedding[i + 1], a.embedding[i + 1]) * 0.8::DOUBLE) AS raw FROM v_tiles a LEFT JOIN v_tiles b ON b.vec_id = a.vec_id + 1),
vecs AS (SELECT vec_id, image, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS text FROM texts)"""


@query("E5 W7 J16", f"""
WITH {_TEXTV}, s AS (SELECT a.vec_id AS i, b.vec_id AS t, round(list_dot_product(a.image, b.text), 6) AS s FROM vecs a, vecs b), o AS (SELECT i AS k, s AS own FROM s WHERE i = t),
i2t AS (SELECT i, 1 + count(*) FILTER (t <> i AND (s > own OR s = own AND t < i)) AS rank FROM s JOIN o ON k = i GROUP BY 1), t2i AS (SELECT t, 1 + count(*) FILTER (t <> i AND (s > own OR s = own AND i < t)) AS rank FROM s JOIN o ON k = t GROUP BY 1),
m AS (SELECT (SELECT avg((rank <= 1)::INT) FROM i2t) AS a1, (SELECT avg((rank <= 5)::INT) FROM i2t) AS a5, (SELECT avg((rank <= 10)::INT) FROM i2t) AS a10, (SELECT avg((rank <= 1)::INT) FROM t2i) AS b1, (SELECT avg((rank <= 5)::INT) FROM t2i) AS b5, (SELECT avg((rank <= 10)::INT) FROM t2i) AS b10)
SELECT round(a1, 4) AS recall_1_i2t, round(a5, 4) AS recall_5_i2t, round(a10, 4) AS recall_10_i2t, round(b1, 4) AS recall_1_t2i, round(b5, 4) AS recall_5_t2i, round(b10, 4) AS recall_10_t2i, round((a1 + b1) / 2, 4) AS recall_1, round((a5 + b5) / 2, 4) AS recall_5, round((a10 + b10) / 2, 4) AS recall_10 FROM m""")
def paired_recall(spark, d):
    c = v.caption_vectors(spark, d)
    key = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    r = EV.paired_recall(c.select(key.alias("tile_id"), "embedding"), c.select(key.alias("query_id"), F.col("text_embedding").alias("embedding")))
    return r.select(*[F.round(x, 4).alias(x) for x in r.columns])


def _batches(spark, d):
    return v.caption_vectors(spark, d).select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("vec_id").alias("item"), F.col("embedding").alias("image"), F.col("text_embedding").alias("text"))


def _ce_sql(weight: str) -> str:
    return f"""
WITH {_TEXTV}, l AS (SELECT a.vec_id // 32 AS batch, a.vec_id AS i, b.vec_id AS t, list_dot_product(a.image, b.text) / 0.07::DOUBLE AS z FROM vecs a JOIN vecs b ON a.vec_id // 32 = b.vec_id // 32),
hard AS (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY i = t, z DESC) = 1 AND i <> t AS hardest FROM l), w AS (SELECT *, CASE WHEN hardest THEN z * {weight} ELSE z END AS y FROM hard),
a AS (SELECT batch, i, max(y) + log_sum AS norm FROM (SELECT *, ln(sum(exp(y - my)) OVER (PARTITION BY batch, i)) AS log_sum FROM (SELECT *, max(y) OVER (PARTITION BY batch, i) AS my FROM w)) GROUP BY batch, i, log_sum),
b AS (SELECT batch, t, max(y) + log_sum AS norm FROM (SELECT *, ln(sum(exp(y - my)) OVER (PARTITION BY batch, t)) AS log_sum FROM (SELECT *, max(y) OVER (PARTITION BY batch, t) AS my FROM w)) GROUP BY batch, t, log_sum),
la AS (SELECT batch, i, -(0.9::DOUBLE * max(CASE WHEN i = t THEN y - norm END) + 0.1::DOUBLE * avg(y - norm)) AS loss, max(CASE WHEN i = t THEN z END) >= max(z) AS hit FROM w JOIN a USING (batch, i) GROUP BY 1, 2),
lb AS (SELECT batch, t, -(0.9::DOUBLE * max(CASE WHEN i = t THEN y - norm END) + 0.1::DOUBLE * avg(y - norm)) AS loss, max(CASE WHEN i = t THEN z END) >= max(z) AS hit FROM w JOIN b USING (batch, t) GROUP BY 1, 2)
SELECT x.batch, x.items, round(x.loss, 5) AS loss_i2t, round(y.loss, 5) AS loss_t2i, round((x.loss + y.loss) / 2, 5) AS loss, round(x.acc, 5) AS accuracy_i2t, round(y.acc, 5) AS accuracy_t2i
FROM (SELECT batch, count(*) AS items, avg(loss) AS loss, avg(hit::INT) AS acc FROM la GROUP BY 1) x JOIN (SELECT batch, avg(loss) AS loss, avg(hit::INT) AS acc FROM lb GROUP BY 1) y USING (batch)"""


def _rounded(df):
    return df.select("batch", "items", *[F.round(c, 5).alias(c) for c in ("loss_i2t", "loss_t2i", "loss", "accuracy_i2t", "accuracy_t2i")])


@query("E6 J16", _ce_sql("1.0"))
def contrastive_batches(spark, d):
    return _rounded(EV.contrastive_batches(_batches(spark, d)))


@query("E6 W6", _ce_sql("2.0"))
def hard_negative_batches(spark, d):
    return _rounded(EV.contrastive_batches(_batches(spark, d), hard_weight=2.0))


@query("E7", f"""
SELECT analysis_id, t1_tile_id, t2_tile_id, t1_date::VARCHAR AS t1_date, t2_date::VARCHAR AS t2_date, change_type, final_score AS confidence, structural, seasonal_confound, cloud_contamination
FROM ({ORACLES["change_analyses"]}) JOIN (SELECT pair_id, t1_date, t2_date FROM v_pixel_pairs) USING (pair_id) WHERE status = 'completed'""")
def change_evaluation(spark, d):
    from orbitloom.plans.change_analysis import analyze_pairs

    px = lambda f: f(spark, d).withColumn("pair_id", F.col("tile_id"))
    out = EV.pair_evaluation(analyze_pairs(v.pixel_pairs(spark, d), px(v.pixels), px(v.pixels_t2)))
    return out.select(
        "analysis_id", "t1_tile_id", "t2_tile_id", F.col("t1_date").cast("string").alias("t1_date"), F.col("t2_date").cast("string").alias("t2_date"),
        "change_type", "confidence", "structural", "seasonal_confound", "cloud_contamination")


# ---- incremental and streams

_CLASSIFY = """
SELECT c.tile_id, CASE WHEN m.tile_id IS NULL THEN 'NEW' WHEN m.content_hash <> c.content_hash OR m.embedding_version <> 'hashing-words-v1' THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change
FROM v_current c LEFT JOIN (SELECT * FROM v_manifest WHERE embedding_model = 'hashing-words') m ON c.tile_id = m.tile_id"""


@query("I1 I2 J11", _CLASSIFY)
def index_changes(spark, d):
    return I.classify(v.current_tiles(spark, d), v.manifest(spark, d), "hashing-words", "hashing-words-v1").select("tile_id", "change")


def _apply(spark, d):
    from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("tile_id", StringType()), StructField("model_name", StringType()), StructField("model_version", StringType()),
                         StructField("vector_dim", IntegerType()), StructField("created_at", TimestampType()), StructField("embedding", ArrayType(FloatType()))])
    return I.index_changes(v.current_tiles(spark, d), v.manifest(spark, d), spark.createDataFrame([], schema), HashingEncoder(DIM), "2024-05-01 00:00:00")


@query("I3 S11", f"""
SELECT tile_id, sha256(content) AS content_hash, 'hashing-words-v1' AS embedding_version, CASE WHEN change = 'UNCHANGED' THEN '2024-01-01' ELSE '2024-05-01' END AS indexed_on FROM ({_CLASSIFY}) JOIN v_current USING (tile_id)""")
def applied_manifest(spark, d):
    return _apply(spark, d)[0].select("tile_id", "content_hash", "embedding_version", F.date_format("indexed_at", "yyyy-MM-dd").alias("indexed_on"))


def _vector_sql(texts: str) -> str:
    """(tile_id, slot, w): the hashing encoder's vectors of (tile_id, text), without zeros."""
    return f"""
SELECT tile_id, slot::INT AS slot, round((w / sqrt(sum(w * w) OVER (PARTITION BY tile_id)))::FLOAT::DOUBLE, 4) AS w FROM (
  SELECT tile_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w
  FROM (SELECT tile_id, unnest(string_split(lower(text), ' ')) AS word FROM ({texts})) WHERE word <> '' GROUP BY 1, 2) WHERE w <> 0"""


def _slots(vectors):
    long = vectors.select("tile_id", F.posexplode("embedding").alias("slot", "w")).where("w <> 0")
    return long.select("tile_id", "slot", F.round(F.col("w").cast("double"), 4).alias("w"))


@query("I3 V12", _vector_sql(f"SELECT tile_id, content AS text FROM ({_CLASSIFY}) JOIN v_current USING (tile_id) WHERE change <> 'UNCHANGED'"))
def applied_vectors(spark, d):
    return _slots(_apply(spark, d)[1])


_ARRIVED = """SELECT (doc_id // 2)::VARCHAR AS tile_id, text, (doc_id // 2) % 5 = 0 AS known FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) = 1"""


@query("I4 I3", f"""
SELECT tile_id, sha256(text) AS content_hash, CASE WHEN known THEN '2023-01-01' ELSE '2024-01-01' END AS indexed_on, slot, w
FROM ({_ARRIVED}) LEFT JOIN ({_vector_sql(f"SELECT tile_id, text FROM ({_ARRIVED}) WHERE NOT known")}) USING (tile_id)""")
def indexed_stream(spark, d):
    """Documents arrive as a file stream in two rounds, two for each tile, of which the later one counts but comes in the first
    round; every fifth tile is known with that content.  The manifest and the vectors afterwards."""
    from orbitloom import schemas
    from orbitloom.session import new_table_path

    enc = HashingEncoder(DIM)
    manifest = ST.KeyedTable(spark, new_table_path(spark, "manifest"), schemas.INDEX_MANIFEST, ["tile_id", "embedding_model"], buckets=8)
    vectors = ST.KeyedTable(spark, new_table_path(spark, "vectors"), schemas.VECTORS, ["tile_id", "model_name"], buckets=8)
    doc = v.table(spark, d, "documents")
    tile = F.floor(F.col("doc_id") / 2)
    known = doc.where(tile % 5 == 0).groupBy(tile.alias("t")).agg(F.max_by("text", "doc_id").alias("text"))
    manifest.merge(known.select(
        F.col("t").cast("string").alias("tile_id"), F.sha2("text", 256).alias("content_hash"), F.lit(enc.name).alias("embedding_model"),
        F.lit(enc.version).alias("embedding_version"), F.to_timestamp(F.lit("2023-01-01 00:00:00")).alias("indexed_at")))
    came, checkpoint = new_table_path(spark, "arrivals"), new_table_path(spark, "ck")
    for first_round in (True, False):
        newest = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
        doc.where(newest if first_round else ~newest).write.mode("append").parquet(came)
        arrivals = spark.readStream.schema(doc.schema).parquet(came).select(
            tile.cast("string").alias("tile_id"), F.col("text").alias("content"), F.col("doc_id").alias("arrived_at"))
        ST.index_stream(arrivals, manifest, vectors, enc, checkpoint).awaitTermination()
    rows = manifest.read().select("tile_id", "content_hash", F.date_format("indexed_at", "yyyy-MM-dd").alias("indexed_on"))
    return rows.join(_slots(vectors.read()), "tile_id", "left").select("tile_id", "content_hash", "indexed_on", "slot", "w")


def _log_stream(spark, d):
    src = v.table(spark, d, "events").schema
    e = spark.readStream.schema(src).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(F.col("event_type").alias("query_type"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("created_at"), "user_id")


@query("I5", """
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, query_type, count(*) AS queries, round(sum(latency_ms), 4) AS latency_sum FROM v_query_log GROUP BY 1, 2""")
def windowed_latency(spark, d):
    t = ST.run_to_table(ST.windowed_latency(_log_stream(spark, d)), ["window_start", "query_type"], "windows")
    return t.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "query_type", "queries", F.round("latency_sum", 4).alias("latency_sum"))


@query("I5", """
SELECT user_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS queries FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at) AS s
FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM v_query_log)) GROUP BY user_id, s""")
def user_sessions(spark, d):
    s = ST.user_sessions(v.query_log(spark, d), "2 hours")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "queries")

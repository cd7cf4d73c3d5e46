"""Registered queries of the training-data operators, with their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import quality, toxicity
from .chat_format import conversation_digests, format_turns, text_parts
from .decontaminate import find_passages
from .line_windows import dedup_lines
from .periodic_runs import find_runs
from .secrets_scan import KINDS, find_secrets
from .segment_sampling import sample_segmentations
from .setsketch import near_duplicates
from .spots import edited_fingerprints
from .suffix_windows import drop_repeated_windows
from .target_sampling import resample
from .url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM worded),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
    FROM sets s JOIN least c ON c.doc_id = s.doc_id
    """)
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, near-duplicate component and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op1_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, with its place and edit distance."""
    return find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampled segmentations with their scores, and whether they decode to the text."""
    return sample_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, probability of toxicity and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probabilities and selection."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts per base kind, a digest of the base spans, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query(
    """
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
    g AS (
      SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(text) + length(role) + 20) AS plain_chars,
             sum(length(regexp_replace(text, '(\\\\|<s>|</s>|\\[/?ROLE\\]|\\[/?INST\\]|<\\|(image|audio|document|end)\\|>)', '\\\\\\1', 'g')) - length(text)) AS extra
      FROM t GROUP BY conv_id)
    SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
           sha256(loss) AS loss_sha256, CAST(plain_chars + extra AS BIGINT) AS formatted_chars,
           CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
    FROM g
    """)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back; conversation -1 speaks the template's control strings."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], talks.schema)
    return conversation_digests(format_turns(text_parts(talks.unionByName(probe))))


@query(
    """
    WITH lines AS (
      SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM documents WHERE text IS NOT NULL),
    wins AS (
      SELECT doc_id, pos, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3
      FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    ranked AS (
      SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS occurrence
      FROM wins WHERE l2 IS NOT NULL AND l3 IS NOT NULL),
    covered AS (
      SELECT DISTINCT doc_id, pos + k AS pos FROM ranked CROSS JOIN (VALUES (0), (1), (2)) t(k) WHERE occurrence > 1),
    left_over AS (
      SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept, count(*) AS n
      FROM lines l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id),
    gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.kept, '') END AS kept_text,
           CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
    FROM documents d LEFT JOIN left_over o ON o.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
    """)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after the removal of repeated three-line passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, kept="kept_text").select("doc_id", "kept_text", "n_removed")


@query(
    """
    WITH rules(host, path, verdict) AS (VALUES
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
    parts AS (
      SELECT page_id,
             translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut),
    fits AS (
      SELECT p.page_id, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
      FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
    """)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest fitting rule and verdict."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


CRC_SQL = """
    bits AS (
      SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
                  ORDER BY i) AS crc_of FROM range(256) t(i)),
"""  # the table of the 256 one-byte checksums
CRC_OF = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(encode({x}))) // 2 + 1),
      lambda k: CAST('0x' || substr(hex(encode({x})), 2 * k - 1, 2) AS BIGINT))),
      lambda c, b: xor(c // 256, crc_of[CAST(xor(c % 256, b) AS BIGINT) + 1])), 4294967295)"""


@query(
    "WITH " + CRC_SQL + r"""
    texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    rows AS (
      SELECT side, id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    items AS (
      SELECT side, id, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM rows),
    each AS (SELECT side, id, r, x, count(*) AS n FROM items GROUP BY ALL),
    spelled AS (SELECT x, """ + CRC_OF.format(x="x") + r""" % 10000 AS bucket FROM (SELECT DISTINCT x FROM each), bits),
    bucketed AS (SELECT side, id, r, bucket, n FROM each JOIN spelled USING (x)),
    counts AS (
      SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
      FROM range(10000) k(b) LEFT JOIN bucketed ON bucket = b GROUP BY b),
    totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
    gains AS (
      SELECT bucket, floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS gain
      FROM counts, totals),
    weighed AS (SELECT r, sum(n) AS n_features, floor(sum(gain * n) / sum(n)) AS weight FROM bucketed JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
    scored AS (
      SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(d.id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
                                                        / 4294967296.0::DOUBLE))) AS score
      FROM rows d LEFT JOIN weighed USING (r) WHERE d.side = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE n_words >= 20) OVER () AS fit
      FROM scored)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
           CAST(CASE WHEN n_words >= 20 AND k <= 25 * fit // 100 THEN k END AS BIGINT) AS rank
    FROM ranked
    """)
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's word features, its score, and its rank among the drawn quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by a hash of the id, repeats a part of its words to the end (see the query's contract)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chosen = docs.withColumn("h", h).withColumn("w", F.when(h % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    g = F.floor(F.col("h") / 10)
    staged = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    moved = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return staged.withColumn("text", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text"))).select("doc_id", "text")


@query(
    "WITH " + CRC_SQL + r"""
    split AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             """ + CRC_OF.format(x="CAST(doc_id AS VARCHAR)") + r""" AS h FROM documents, bits),
    chosen AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
    edited AS (
      SELECT doc_id, r, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
                           ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM chosen),
    words AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM edited),
    twins AS (SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
    islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM twins),
    stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT r, s, len, min(q) AS q FROM stretches GROUP BY r, s, len),
    covered AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
    left_over AS (
      SELECT w.r, string_agg(w.x, ' ' ORDER BY w.i) AS kept FROM words w ANTI JOIN covered c ON w.r = c.r AND w.i = c.i GROUP BY w.r),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS k FROM runs),
    listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY r)
    SELECT e.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.len AS BIGINT) AS length,
           CAST(b.q AS BIGINT) AS period, CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256,
           sha256(coalesce(o.kept, '')) AS collapsed_sha256
    FROM edited e LEFT JOIN listed l ON l.r = e.r LEFT JOIN best b ON b.r = e.r AND b.k = 1 LEFT JOIN left_over o ON o.r = e.r
    """)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words: their number, the one of the greatest exponent, digests of all and of the rest."""
    found = find_runs(with_planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda held, x: F.when(longer(x, held), x).otherwise(held))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    lines = F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(
    """
    WITH texts AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
    sized AS (SELECT *, length(x) // 2 AS n FROM texts),
    pieces AS (
      SELECT r, p, substr(x, 2000 * p + 1, 2798) AS y FROM (SELECT r, x, unnest(range((n - 400) // 1000 + 1)) AS p FROM sized WHERE n >= 400)),
    windows AS (
      SELECT r, 1000 * p + k AS i, substr(y, 2 * k + 1, 800) AS win FROM (SELECT r, p, y, unnest(range(length(y) // 2 - 399)) AS k FROM pieces)),
    hashed AS (SELECT r, i, md5_number(win) AS h FROM windows),
    again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
    starts AS (SELECT r, i FROM hashed SEMI JOIN again USING (h)),
    edges AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM starts),
    labelled AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM edges),
    spans AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM labelled GROUP BY r, span),
    gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
    left_over AS (
      SELECT g.r, string_agg(substr(t.x, CAST(2 * g.since + 1 AS BIGINT), CAST(2 * (g.a - g.since) AS BIGINT)), '' ORDER BY g.a) AS head,
             max(g.b) AS last, sum(g.b - g.a) AS n_removed, count(*) AS n_spans
      FROM gaps g JOIN texts t ON t.r = g.r GROUP BY g.r)
    SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(o.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(o.n_spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(CASE WHEN o.r IS NULL THEN t.x ELSE o.head || substr(t.x, CAST(2 * o.last + 1 AS BIGINT)) END)) AS kept_sha256
    FROM sized t LEFT JOIN left_over o ON o.r = t.r
    """)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, how many of them lie in repeated 400-byte strings, in how many stretches, and a digest of the rest."""
    found = drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""The same views as `views`, as DuckDB SQL."""

from __future__ import annotations

from .views import BLOCKS, LEVELS, NOISE, PLACES, SCENE_NAMES, THEMES


def case(index: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def tile_name(number: str) -> str:
    return f"'tile_' || lpad({number}::VARCHAR, greatest(5, length({number}::VARCHAR))::INT, '0')"


_SCENE = f"'scene_' || label || '_' || {case('label', SCENE_NAMES)}"
_T, _P = case("o_orderkey % 7", THEMES), case("o_orderkey % 5", PLACES)

def pct(x: str) -> str:
    """100 * x to one decimal, half up on the printed value."""
    return f"round((({x}) * 100)::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE"


def _pixel_sql(date: int) -> str:
    bands = []
    for i, b in enumerate(NOISE):
        n = f"n{i + 1}"
        level = {"low": f"{n} + 20", "mid": f"{n} * 3 + 90", "high": f"{n} % 6 + 250"}
        whens = f"WHEN row < 4 THEN {n} + 225 WHEN row >= 28 THEN {n}"
        for k, areas in BLOCKS.items():
            for lo, hi in areas:
                whens += f" WHEN tile % 4 = {k} AND row BETWEEN {lo} AND {hi} AND col BETWEEN {lo} AND {hi} THEN {level[LEVELS[k][b][date - 1]]}"
        bands.append(f"(CASE {whens} ELSE {level['mid']} END)::INT AS {b}")
    return f"SELECT tile, row, col, tile_id, {', '.join(bands)} FROM v_noise"


VIEWS = {
    "v_scenes": f"""
SELECT DISTINCT {_SCENE} AS scene_id, {case('label % 3', ('Sentinel-2', 'Landsat-8', 'Sentinel-1'))} AS sensor,
       CASE WHEN label <> 9 THEN DATE '2024-01-15' + label * 30 END AS acquisition_date,
       DATE '2024-06-01' + label % 4 AS ingested_on
FROM embeddings""",
    "v_tiles": f"""
SELECT {tile_name('vec_id')} AS tile_id, {_SCENE} AS scene_id,
       (vec_id % 20)::INT AS x_index, floor(vec_id / 20.0)::BIGINT::INT AS y_index,
       round(91.60::DOUBLE + 0.02::DOUBLE * (vec_id % 20), 4) AS center_lon,
       round(26.05::DOUBLE + 0.02::DOUBLE * floor(vec_id / 20.0)::BIGINT, 4) AS center_lat,
       round(91.60::DOUBLE + 0.02::DOUBLE * (vec_id % 20) - 0.01::DOUBLE, 4) AS bounds_minx,
       round(26.05::DOUBLE + 0.02::DOUBLE * floor(vec_id / 20.0)::BIGINT - 0.01::DOUBLE, 4) AS bounds_miny,
       round(91.60::DOUBLE + 0.02::DOUBLE * (vec_id % 20) + 0.01::DOUBLE, 4) AS bounds_maxx,
       round(26.05::DOUBLE + 0.02::DOUBLE * floor(vec_id / 20.0)::BIGINT + 0.01::DOUBLE, 4) AS bounds_maxy,
       embedding::DOUBLE[] AS embedding, label, vec_id
FROM embeddings""",
    "v_headers": """
SELECT *, bounds_minx + width * CASE WHEN starts_with(crs, 'EPSG:32') THEN 10.0::DOUBLE ELSE 0.0001::DOUBLE END AS bounds_maxx,
  bounds_miny + height * CASE WHEN starts_with(crs, 'EPSG:32') THEN 10.0::DOUBLE ELSE 0.0001::DOUBLE END AS bounds_maxy FROM (
SELECT o_orderkey AS header_key, '/raw/' || o_orderstatus || '/' || CASE o_orderkey % 12
    WHEN 0 THEN 'S2A_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || '_T' || o_orderkey || '.tif'
    WHEN 1 THEN 'S1B_IW_GRD_' || strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey || '.tiff'
    WHEN 2 THEN 'LC08_L1TP_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.TIF'
    WHEN 3 THEN 'landsat 9 scene ' || strftime(o_orderdate, '%Y_%m_%d') || ' ' || o_orderkey || '.tif'
    WHEN 4 THEN 'MOD09_' || strftime(o_orderdate, '%Y%m%d') || '.' || o_orderkey || '.geotiff'
    WHEN 5 THEN 'planet_psscene_x' || o_orderkey || 'x.tif'
    WHEN 6 THEN 'aerial-' || strftime(o_orderdate, '%Y-%m-%d') || '-x' || o_orderkey || '.png'
    WHEN 7 THEN 'sentinel2_x' || o_orderkey || '_20240230.tif'
    WHEN 8 THEN 'L9_' || strftime(o_orderdate, '%Y%m%d') || '_x' || o_orderkey || '.tif'
    WHEN 9 THEN 'MYD11_' || strftime(o_orderdate, '%Y%m%d') || '_x' || o_orderkey || '.tif'
    WHEN 10 THEN 'survey_x' || o_orderkey || '.jp2'
    ELSE 'S2_x' || strftime(o_orderdate, '%Y_%m_%d') || '_x' || o_orderkey || '.tif' END AS file_path,
  o_orderkey % 97 <> 13 AS present, o_orderkey % 89 <> 7 AS readable,
  CASE WHEN o_orderkey % 11 = 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'EPSG:32646' ELSE 'EPSG:32719' END WHEN o_orderkey % 11 = 8 THEN 'EPSG:3857' WHEN o_orderkey % 7 <> 3 THEN 'EPSG:4326' END AS crs,
  CASE WHEN o_orderkey % 50 = 1 THEN 0 ELSE 100 + (o_orderkey * 37) % 1400 END::INT AS width,
  (100 + (o_orderkey * 53) % 1100)::INT AS height, (o_orderkey % 5)::INT AS band_count,
  CASE WHEN o_orderkey % 11 = 5 THEN 300000.0::DOUBLE + (o_orderkey % 300) * 1000.0::DOUBLE ELSE 60.0::DOUBLE + (o_orderkey % 300) * 0.1::DOUBLE END AS bounds_minx,
  CASE WHEN o_orderkey % 11 = 5 THEN 2800000.0::DOUBLE + (o_orderkey % 250) * 1000.0::DOUBLE ELSE 8.0::DOUBLE + (o_orderkey % 250) * 0.1::DOUBLE END AS bounds_miny,
  CASE WHEN o_orderkey % 6 = 2 THEN 'Override-1' WHEN o_orderkey % 6 = 4 THEN '' END AS sensor_given,
  CASE WHEN o_orderkey % 8 = 3 THEN '2020-02-02' END AS date_given
FROM orders)""",
    # facts from the file name
    "v_named": r"""
SELECT *, regexp_extract(file_path, '([^/]+)$', 1) AS name,
  upper(regexp_extract(file_path, '([^/]+)$', 1)) AS up,
  regexp_replace(regexp_extract(file_path, '([^/]+)$', 1), '\.[^.]*$', '') AS stem,
  lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) AS suffix,
  nullif(regexp_extract(file_path, '(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])', 0), '') AS packed
FROM v_headers""",
    "v_scene_facts": r"""
SELECT *, COALESCE(nullif(sensor_given, ''), CASE
    WHEN regexp_matches(up, 'S2[AB]?_|SENTINEL.?2|^S2_') THEN 'Sentinel-2'
    WHEN regexp_matches(up, 'S1[AB]?_|SENTINEL.?1') THEN 'Sentinel-1'
    WHEN regexp_matches(up, 'LC08|LANDSAT.?8|L8_') THEN 'Landsat-8'
    WHEN regexp_matches(up, 'LC09|LANDSAT.?9|L9_') THEN 'Landsat-9'
    WHEN regexp_matches(up, 'MOD\d{2}|MYD\d{2}') THEN 'MODIS'
    WHEN regexp_matches(up, 'PLANET') THEN 'PlanetScope' END) AS sensor,
  COALESCE(date_given, strftime(try_strptime(packed, '%Y%m%d'), '%Y-%m-%d'),
    nullif(regexp_extract(name, '(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])', 0), ''),
    replace(nullif(regexp_extract(name, '(\d{4})_(0[1-9]|1[0-2])_(0[1-9]|[12]\d|3[01])', 0), ''), '_', '-')) AS acquisition_date
FROM v_named""",
    "v_scene_ids": r"""
SELECT *, concat_ws('_', upper(substr(replace(replace(sensor, '-', ''), ' ', ''), 1, 4)), replace(acquisition_date, '-', ''),
  regexp_replace(stem, '[^a-zA-Z0-9_-]', '_', 'g')) AS scene_id
FROM v_scene_facts""",
    "v_queries": f"""
SELECT 'q-' || o_orderkey AS query_id, CASE o_orderkey % 11
    WHEN 0 THEN 'show ' || {_T} || ' in ' || {_P} || ' between january and august 2024 with cloud cover < ' || (o_orderkey % 50) || '%'
    WHEN 1 THEN 'Find locations similar to ' || {_T}
    WHEN 2 THEN 'what has changed around ' || {_P} || ' since ' || strftime(o_orderdate, '%Y-%m-%d')
    WHEN 3 THEN 'Where did this data come from: provenance of ' || {_T}
    WHEN 4 THEN 'describe the land cover visible in ' || {_P}
    WHEN 5 THEN 'locate ' || {_T} || ' from 2024-02-01 to 2024-09-30 sentinel-2'
    WHEN 6 THEN {_T} || ' [91.60, 26.00, 91.80, 26.30]'
    WHEN 7 THEN 'show me ' || {_T} || ' during march 2024 landsat'
    WHEN 8 THEN 'search for ' || {_T} || ' near ' || {_P} || ' after 2024-03-01'
    WHEN 9 THEN '  ' || {_T} || ' '
    ELSE 'find ' || {_T} || ' sar imagery across ' || {_P} || ' between foo and bar with cloud under ' || (o_orderkey % 50) || '%' END AS text,
  CASE WHEN o_orderkey % 4 = 0 THEN {tile_name('(o_orderkey // 4)')} END AS tile_id,
  CASE WHEN o_orderkey % 9 = 4 THEN 'Landsat-8' END AS sensor_given
FROM orders""",
    "v_noise": """
SELECT (event_id // 1024)::INT AS tile, ((event_id % 1024) // 32)::INT AS row, (event_id % 32)::INT AS col,
  floor(value)::INT % 10 AS n1, floor(value * 3)::INT % 10 AS n2, floor(value * 5)::INT % 10 AS n3, floor(value * 7)::INT % 10 AS n4,
  'px_' || lpad((event_id // 1024)::VARCHAR, 6, '0') AS tile_id
FROM events""",
    "v_pixels": _pixel_sql(1),
    "v_pixels_t2": _pixel_sql(2),
    "v_pixel_pairs": """
SELECT DISTINCT tile_id AS pair_id, tile_id, tile_id || '_t1' AS t1_tile_id, tile_id || '_t2' AS t2_tile_id,
  DATE '2024-01-15' + (tile * 17) % 365 AS t1_date,
  CASE WHEN tile % 5 <> 4 THEN DATE '2024-01-15' + ((tile * 17) % 365 + (tile * 41) % 300) END AS t2_date
FROM v_pixels""",
    "v_obs": """
SELECT o_custkey AS site, o_orderkey AS obs_id, o_orderdate::DATE AS date, 'obs_' || o_orderkey AS tile_id, c_mktsegment AS sensor,
  o_totalprice % 1000 / 100 AS change_pct, o_orderkey % 9 <> 0 AS has_image
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_query_log": """
SELECT 'q-' || event_id AS query_id, event_type AS query_type, value AS latency_ms, ts AS created_at, props AS filters, user_id, event_id
FROM events""",
    "v_provenance": """
SELECT 'prov-' || lpad(event_id::VARCHAR, 9, '0') AS provenance_id, event_type AS entity_type, 'u-' || user_id AS entity_id,
  props AS parameters, value AS confidence, ts AS created_at, 'hashing-words' AS embedding_model
FROM events""",
    "v_current": """
SELECT doc_id::VARCHAR AS tile_id, sha256(text) AS content_hash, text AS content FROM documents""",
    "v_manifest": """
SELECT doc_id::VARCHAR AS tile_id, CASE WHEN doc_id % 5 = 0 THEN md5(text) ELSE sha256(text) END AS content_hash,
  'hashing-words' AS embedding_model, CASE WHEN doc_id % 7 = 1 THEN 'hashing-words-v0' ELSE 'hashing-words-v1' END AS embedding_version,
  TIMESTAMP '2024-01-01 00:00:00' AS indexed_at
FROM documents WHERE doc_id % 3 <> 0""",
    "v_pairs": """
SELECT doc_id::VARCHAR AS tile_id, text AS caption, lang AS land_cover, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE 1 END AS label, source AS scene_id
FROM documents""",
    "v_index": """
SELECT 'idx_' || o_orderkey AS tile_id, 'scene_' || (o_orderkey % 4) AS scene_id, (o_orderkey % 121 - 40) / 100.0::DOUBLE AS v, ((o_orderkey // 3) % 71 - 35) / 100.0::DOUBLE AS w,
  (o_orderkey % 97) / 100.0::DOUBLE AS b, (o_orderkey % 13) / 100.0::DOUBLE AS s, (o_orderkey % 17) / 100.0::DOUBLE AS t,
  CASE o_orderkey % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'pre_monsoon' WHEN 2 THEN 'monsoon' END AS season FROM orders""",
    "v_cover_rules": """
SELECT tile_id, 0 AS ord, 'dense_vegetation' AS class, least(1.0, (v - 0.45) / 0.3 + 0.5) AS score FROM v_index WHERE v > 0.45
UNION ALL SELECT tile_id, 1, 'sparse_vegetation', least(1.0, (v - 0.20) / 0.25 + 0.3) FROM v_index WHERE v > 0.20 AND v <= 0.45
UNION ALL SELECT tile_id, 2, 'water', CASE WHEN w > 0.10 THEN least(1.0, (w - 0.10) / 0.3 + 0.5) ELSE 0.4 END FROM v_index WHERE w > 0.10 OR (w > -0.05 AND b < 0.20)
UNION ALL SELECT tile_id, 3, 'built_up', CASE WHEN v < 0.15 AND b > 0.35 THEN least(1.0, b * 1.2) ELSE 0.5 END FROM v_index WHERE (v < 0.15 AND b > 0.35) OR (v < 0.20 AND b > 0.30 AND t > 0.08)
UNION ALL SELECT tile_id, 4, 'bare_soil', 0.6 FROM v_index WHERE v < 0.15 AND b < 0.35 AND b > 0.10
UNION ALL SELECT tile_id, 5, 'agricultural', least(1.0, 0.5 + (0.55 - abs(v - 0.40)) / 0.3) FROM v_index WHERE v > 0.25 AND v < 0.55 AND t < 0.10
UNION ALL SELECT tile_id, 6, 'cloud_or_haze', 0.8 FROM v_index WHERE b > 0.75 AND s < 0.05""",
    "v_cover": """
SELECT tile_id, class, round(score::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY tile_id ORDER BY round(score::DOUBLE, 6) DESC, ord) AS place FROM v_cover_rules
UNION ALL SELECT tile_id, 'mixed', 0.5::DOUBLE, 1 FROM v_index WHERE tile_id NOT IN (SELECT tile_id FROM v_cover_rules)""",
    "v_main_cover": """
SELECT i.*, a.class AS main, c.class AS second, 'terrain with ' || concat_ws(' and ', CASE WHEN v > 0.5 THEN 'high vegetation density' WHEN v > 0.3 THEN 'moderate vegetation cover' WHEN v > 0.15 THEN 'sparse vegetation' ELSE 'minimal vegetation' END,
  CASE WHEN w > 0.15 THEN 'significant water presence' WHEN w > 0.0 THEN 'traces of moisture or water' END, CASE WHEN b > 0.6 THEN 'high reflectance from bright surfaces' WHEN b < 0.15 THEN 'dark surface features' END) AS phrase
FROM v_index i JOIN v_cover a ON i.tile_id = a.tile_id AND a.place = 1 LEFT JOIN v_cover c ON i.tile_id = c.tile_id AND c.place = 2""",
    "v_reviews": """
SELECT doc_id AS analysis_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'confirmed'
  WHEN doc_id % 4 = 0 THEN 'maybe' ELSE 'uncertain' END AS decision FROM labels""",
}


def _parse_views() -> None:
    """Views of the query-text rules, built from the fixed word lists."""
    from orbitloom import vocab as w
    from orbitloom.functions import querytext as q

    def alt(cases) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in cases) + " END"

    scores = []
    for name, weight, words, patterns in w.INTENTS:
        s = " + ".join(f"contains(low, '{x}')::INT" for x in words)
        p = " OR ".join(f"regexp_matches(low, '{x}')" for x in patterns)
        boost = f" * (CASE WHEN tile_id <> '' THEN {w.CONTEXT_BOOST}::DOUBLE ELSE 1.0::DOUBLE END)" if name in w.CONTEXT_BOOSTED else ""
        scores.append(f"round((({s}) * {weight * 0.5}::DOUBLE + CASE WHEN {p} THEN {weight * 0.7}::DOUBLE ELSE 0.0::DOUBLE END){boost}, 6) AS s_{name.lower()}")
    VIEWS["v_lowered"] = r"SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS base, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS low FROM v_queries"
    names = [i[0] for i in w.INTENTS]
    top = "greatest(" + ", ".join(f"s_{n.lower()}" for n in names) + ")"
    VIEWS["v_intents"] = f"SELECT *, {', '.join(scores)} FROM v_lowered"
    best = alt([(f"{top} < 0.1", "'SEMANTIC_SEARCH'")] + [(f"s_{n.lower()} = {top}", f"'{n}'") for n in names])
    region = alt([(f"regexp_matches(low, '\\b{r[0]}\\b')", f"'{r[0]}'") for r in w.REGIONS])
    VIEWS["v_regions"] = f"SELECT *, {best} AS intent, {region} AS region FROM v_intents"
    month = lambda e: "(CASE " + e + " " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in w.MONTHS) + " END)"
    m1, m2 = month(f"regexp_extract(low, '{q.MONTH_RANGE}', 1)"), month(f"regexp_extract(low, '{q.MONTH_RANGE}', 2)")
    m3 = month(f"regexp_extract(low, '{q.MONTH_ONE}', 1)")
    VIEWS["v_dates"] = f"""
SELECT *, {m1} AS m1, {m2} AS m2, coalesce(nullif(regexp_extract(low, '{q.MONTH_RANGE}', 3), '')::INT, 2024) AS y1,
  {m3} AS m3, nullif(regexp_extract(low, '{q.MONTH_ONE}', 2), '')::INT AS y3, regexp_extract_all(text, '{q.ISO_DATE}', 1) AS iso,
  low LIKE '%after%' OR low LIKE '%since%' AS since,
  nullif(regexp_extract(text, '{q.BBOX}', 1), '')::DOUBLE AS b1, nullif(regexp_extract(text, '{q.BBOX}', 2), '')::DOUBLE AS b2,
  nullif(regexp_extract(text, '{q.BBOX}', 3), '')::DOUBLE AS b3, nullif(regexp_extract(text, '{q.BBOX}', 4), '')::DOUBLE AS b4
FROM v_regions"""
    box = lambda i: f"coalesce(b{i}, CASE region " + " ".join(f"WHEN '{r[0]}' THEN {r[i]}::DOUBLE" for r in w.REGIONS) + " END)"
    p = "base"
    for pattern in q.STRIP_CLAUSES:
        p = f"regexp_replace({p}, '{pattern}', '', 'g')"
    VIEWS["v_stripped"] = f"""
SELECT *, {box(1)} AS bbox_minx, {box(2)} AS bbox_miny, {box(3)} AS bbox_maxx, {box(4)} AS bbox_maxy,
  CASE WHEN len(iso) >= 2 OR (len(iso) = 1 AND since) THEN iso[1] WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN make_date(y1, m1, 1)::VARCHAR
    ELSE make_date(y3, m3, 1)::VARCHAR END AS date_from,
  CASE WHEN len(iso) >= 2 THEN iso[2] WHEN len(iso) = 1 AND NOT since THEN iso[1] WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN last_day(make_date(y1, m2, 1))::VARCHAR
    ELSE last_day(make_date(y3, m3, 1))::VARCHAR END AS date_to,
  nullif(regexp_extract(low, '{q.CLOUD}', 1), '')::DOUBLE AS max_cloud_cover,
  CASE WHEN low LIKE '%sentinel-2%' OR low LIKE '%sentinel 2%' THEN 'Sentinel-2' WHEN low LIKE '%landsat%' THEN 'Landsat-8'
    WHEN low LIKE '%sar%' OR low LIKE '%sentinel-1%' THEN 'Sentinel-1' END AS sensor,
  {p} AS p1 FROM v_dates"""
    VIEWS["v_placeless"] = r"""
SELECT *, CASE WHEN region IS NULL THEN p1 ELSE regexp_replace(regexp_replace(p1, '(?i)\b(?:in|around|near|across)\s+' || region || '\b', '', 'g'),
  '(?i)\b' || region || '\b', '', 'g') END AS p2 FROM v_stripped"""
    VIEWS["v_prompted"] = rf"""
SELECT *, trim(regexp_replace(regexp_replace(p2, '{q.LEADING_VERB}', ''), '\s+', ' ', 'g'), ' ,.-') AS p3 FROM v_placeless"""
    change = " OR ".join(f"contains(low, '{x}')" for x in w.CHANGE_WORDS)
    title = alt([(f"region = '{r[0]}'", f"'{r[0].title()}'") for r in w.REGIONS])
    VIEWS["v_parsed"] = f"""
SELECT query_id, text, tile_id, sensor_given, intent, intent = 'CHANGE_ANALYSIS' OR {change} AS is_change_query, {title} AS location,
  bbox_minx, bbox_miny, bbox_maxx, bbox_maxy, date_from, date_to, max_cloud_cover, sensor,
  CASE WHEN length(p3) < 4 THEN base ELSE p3 END AS cleaned_prompt FROM v_prompted"""
    # the same parse without a selected tile, and the searches it asks for
    VIEWS["v_searches"] = """
SELECT query_id, cleaned_prompt, bbox_minx, bbox_miny, bbox_maxx, bbox_maxy, date_from, date_to, coalesce(sensor_given, sensor) AS sensor FROM v_parsed"""
    tpl = ", ".join("'" + t + "'" for t in w.PROMPT_TEMPLATES)
    VIEWS["v_prompts"] = "SELECT DISTINCT cleaned_prompt FROM v_parsed"
    VIEWS["v_filled"] = f"SELECT cleaned_prompt, i, replace(t, '%s', trim(cleaned_prompt)) AS prompt FROM v_prompts, (SELECT unnest([{tpl}]) AS t, unnest(range({len(w.PROMPT_TEMPLATES)})) AS i)"
    VIEWS["v_words"] = "SELECT cleaned_prompt, i, unnest(string_split(lower(prompt), ' ')) AS word FROM v_filled"
    VIEWS["v_slots"] = """
SELECT cleaned_prompt, i, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot,
  sum(CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM v_words WHERE word <> '' GROUP BY 1, 2, 3"""
    VIEWS["v_unit_slots"] = "SELECT cleaned_prompt, i, slot, w / sqrt(sum(w * w) OVER (PARTITION BY cleaned_prompt, i)) AS w FROM v_slots"
    VIEWS["v_mean_slots"] = f"SELECT cleaned_prompt, slot, sum(w) / {len(w.PROMPT_TEMPLATES)} AS w FROM v_unit_slots GROUP BY 1, 2"
    VIEWS["v_prompt_vectors"] = "SELECT cleaned_prompt, slot, w / sqrt(sum(w * w) OVER (PARTITION BY cleaned_prompt)) AS w FROM v_mean_slots"
    VIEWS["v_prompt_scores"] = """
SELECT cleaned_prompt, tile_id, sum(w * embedding[slot + 1]) AS score FROM v_prompt_vectors, v_tiles GROUP BY 1, 2"""
    dom = lambda col, side: " + ".join(
        "(CASE WHEN " + " OR ".join(f"contains({col}, '{x}')" for x in d[side]) + f" THEN {1 << i} ELSE 0 END)" for i, d in enumerate(w.DOMAINS))
    VIEWS["v_rule_tiles"] = f"""
SELECT t.*, s.sensor, s.acquisition_date, {dom('t.scene_id', 2)} AS confirms, {dom('t.scene_id', 3)} AS contradicts,
  ('0x' || substr(md5(tile_id), 1, 8))::BIGINT AS code FROM v_tiles t JOIN v_scenes s USING (scene_id)"""
    VIEWS["v_prompt_domains"] = f"SELECT cleaned_prompt, {dom('lower(cleaned_prompt)', 1)} AS domains FROM v_prompts"
    hit_text = "CASE " + " ".join(f"WHEN (domains & confirms & {1 << i}) <> 0 THEN '{d[4]}'" for i, d in enumerate(w.DOMAINS))
    miss_text = " ".join(f"WHEN (domains & contradicts & {1 << i}) <> 0 THEN '{d[5]}'" for i, d in reversed(list(enumerate(w.DOMAINS))))
    before, after = w.UNVERIFIED_TEXT.replace("%%", "%").split("%s")
    global REASON
    REASON = f"{hit_text} {miss_text} ELSE '{before}' || {pct('verified')}::VARCHAR || '{after}' END"


REASON = ""
_parse_views()


def _caption_views() -> None:
    """Template tables and caption rules, built from the fixed texts."""
    from orbitloom import vocab as w

    rows = lambda table: ", ".join(f"('{c}', '{t}')" for c, ts in table for t in ts)
    VIEWS["v_templates"] = f"SELECT * FROM (VALUES {rows(w.CAPTION_TEMPLATES)}) k(class, text)"
    VIEWS["v_seasons"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in w.SEASONS) + ") k(season, line)"
    h = lambda purpose, text: f"md5(tile_id || '|42|{purpose}|' || {text})"
    VIEWS["v_primary"] = f"""
SELECT m.tile_id, 'a satellite image showing ' || t.text || CASE WHEN s.line IS NOT NULL AND {h('season', 't.text')} >= '8' THEN ' ' || s.line ELSE '' END AS caption
FROM v_main_cover m JOIN v_templates t ON t.class = m.main LEFT JOIN v_seasons s ON s.season = m.season QUALIFY row_number() OVER (PARTITION BY m.tile_id ORDER BY {h('primary', 't.text')}) <= 5"""
    VIEWS["v_mix"] = f"""
SELECT tile_id, 'a satellite image showing ' || a || ' with ' || b AS caption FROM (SELECT m.tile_id, min_by(t.text, {h('mix1', 't.text')}) AS a FROM v_main_cover m JOIN v_templates t ON t.class = m.main GROUP BY 1)
JOIN (SELECT m.tile_id, min_by(t.text, {h('mix2', 't.text')}) AS b FROM v_main_cover m JOIN v_templates t ON t.class = m.second GROUP BY 1) USING (tile_id)"""
    VIEWS["v_captions"] = f"""
SELECT tile_id, caption FROM (SELECT * FROM v_primary UNION ALL SELECT * FROM v_mix UNION ALL SELECT tile_id, 'a satellite image of ' || phrase FROM v_main_cover)
QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY {h('order', 'caption')}) <= 5"""
    absent = ", ".join(f"('{c}')" for c, _ in w.CAPTION_TEMPLATES if c not in w.NOT_NEGATIVE)
    VIEWS["v_absent"] = f"""
SELECT i.tile_id, k.class FROM v_index i, (VALUES {absent}) k(class) WHERE NOT EXISTS (SELECT 1 FROM v_cover c WHERE c.tile_id = i.tile_id AND c.class = k.class)
QUALIFY row_number() OVER (PARTITION BY i.tile_id ORDER BY {h('absent', 'k.class').replace('tile_id', 'i.tile_id')}) <= 3"""
    VIEWS["v_negatives"] = f"""
SELECT tile_id, 'a satellite image showing ' || min_by(t.text, {h('negative', 't.text')}) AS caption FROM v_absent JOIN v_templates t USING (class) GROUP BY tile_id, class"""
    cur = ", ".join(f"('{c}', '{t}')" for c, ts in w.CURATED_QUERIES for t in ts)
    default = ", ".join(f"'{t}'" for t in w.CURATED_DEFAULT)
    known = ", ".join(f"'{c}'" for c, _ in w.CURATED_QUERIES)
    VIEWS["v_curated"] = f"""
SELECT tile_id, 'a satellite image showing ' || k.text AS caption FROM v_main_cover m JOIN (VALUES {cur}) k(class, text) ON k.class = m.main
UNION ALL SELECT tile_id, 'a satellite image showing ' || unnest([{default}]) FROM v_main_cover WHERE main NOT IN ({known})"""
    VIEWS["v_training"] = """
SELECT tile_id, caption, 1 AS label, NULL AS source FROM v_captions UNION ALL SELECT tile_id, caption, 0, NULL FROM v_negatives UNION ALL SELECT tile_id, caption, 1, 'curated' FROM v_curated"""
    VIEWS["v_training_rows"] = """
SELECT t.*, scene_id, main AS land_cover, round(v, 3) AS ndvi FROM v_training t JOIN v_main_cover USING (tile_id)"""
    VIEWS["v_tile_order"] = "SELECT tile_id, row_number() OVER (ORDER BY md5(tile_id || '|42'), tile_id) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT tile_id FROM v_training)"
    VIEWS["v_split"] = """
SELECT r.*, CASE WHEN rank <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM v_training_rows r JOIN v_tile_order USING (tile_id)"""
    names = ", ".join(f"'{c}'" for c, _ in w.CLASS_CAPTIONS)
    VIEWS["v_class_files"] = f"""
SELECT '/eurosat/' || class_name || '/' || class_name || '_' || p_partkey || '.jpg' AS path, class_name FROM (SELECT p_partkey, ([{names}])[p_partkey % 10 + 1] AS class_name FROM part)"""
    VIEWS["v_class_captions"] = f"SELECT * FROM (VALUES {rows(w.CLASS_CAPTIONS)}) k(class_name, caption)"
    named = "'COASTAL_AGRICULTURE', 'URBAN_INDUSTRIAL_HUB', 'FOREST_WATERSHED', 'SUNDARBANS_MANGROVE', 'BRAHMAPUTRA', 'BHADLA', 'MUMBAI_PORT', 'GUWAHATI', 'PLATEAU'"
    VIEWS["v_named_tiles"] = f"SELECT ([{named}])[c_custkey % 9 + 1] || CASE WHEN c_custkey % 2 = 0 THEN '_tile_' ELSE '_' END || c_custkey AS tile_id FROM customer"
    VIEWS["v_scene_categories"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, cs in w.SCENE_CATEGORIES for c in cs) + ") k(keyword, category)"
    VIEWS["v_taxonomy"] = f"SELECT * FROM (VALUES {rows(w.QUERY_TAXONOMY)}) k(category, caption)"
    cats = ", ".join(f"'{c}'" for c in w.DEFAULT_CATEGORIES)
    VIEWS["v_tile_categories"] = f"""
SELECT DISTINCT tile_id, category FROM v_named_tiles JOIN v_scene_categories ON contains(tile_id, keyword)
UNION ALL SELECT tile_id, unnest([{cats}]) FROM v_named_tiles t WHERE NOT EXISTS (SELECT 1 FROM v_scene_categories WHERE contains(t.tile_id, keyword))"""


_caption_views()

VERIFIED = """round(CASE WHEN (domains & confirms) <> 0 THEN least(0.985::DOUBLE, greatest(0.88::DOUBLE, 0.94::DOUBLE + code % 100 / 1000.0::DOUBLE * 0.04::DOUBLE + raw * 0.15::DOUBLE))
  WHEN (domains & contradicts) <> 0 THEN 0.35::DOUBLE + code % 50 / 500.0::DOUBLE
  ELSE least(0.85::DOUBLE, greatest(0.60::DOUBLE, 0.72::DOUBLE + raw * 0.5::DOUBLE)) END, 6)"""
ALIGNED = "CASE WHEN (domains & confirms) <> 0 THEN true WHEN (domains & contradicts) <> 0 THEN false ELSE verified >= 0.75 END"

import random
import re
import string

from pyspark.sql import functions as F

from orbitloom.llm import secrets_scan as S
from orbitloom.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute_base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "abcdefgh", "AKIA", "ABCDEFGH1234", "a1" * 16, "ö", "\n", ".", "passwd"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [s for s in S.scan(text) if s[0] != "random"] == brute_base(text), text


def test_a_short_value_still_consumes_its_text():
    assert S.scan('token: api_key": abcdefghijk') == []


def test_random_strings_are_found_and_others_are_not():
    rng = random.Random(2)
    found = 0
    for _ in range(200):
        run = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
        text = f"see {run} there"
        found += S.scan(text) == [("random", 4, 36)]
    assert found >= 196
    for clean in (
        "getUserAccountSettingsByIdentifier", "a_rather_long_snake_case_identifier_name", "internationalization/localization/resources",
        "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "2024-01-15/2024-02-15/report", "=" * 60, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 25 + "abc",
    ):
        assert S.scan(f"x {clean} y") == [], clean


def test_words_beside_a_random_string_do_not_hide_it():
    rng = random.Random(7)
    for words in ("https/hooks/services/internal/production/", "client_credentials_for_production="):
        found = 0
        for _ in range(200):
            run = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
            found += S.scan(f"{words}{run}") == [("random", len(words), len(words) + 32)] or S.scan(f"{words}{run}") == [("random", 0, len(words) + 32)]
        assert found >= 190
    for clean in ("documents/uploads/internal/production/archive/backup/12345678-e89b-12d3-a456-426614174000", "internationalization/documentation/production/D41D8CD98F00B204E9800998ECF8427E"):
        assert S.scan(clean) == [], clean


def test_a_random_span_does_not_overlap_a_base_one():
    run = "Zq8Xw2Lp9Rt4Vb6Nm1Kd7Hs3"
    assert [s[0] for s in S.scan(f"token={run} and {run}")] == ["assign", "random"]


def test_very_long_runs_are_read_whole():
    rng = random.Random(3)
    run = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(200_000))
    assert S.scan(run) == [("random", 0, 200_000)]


def test_awkward_rows(awkward, nothing):
    rows = S.find_secrets(awkward.withColumn("spans", F.lit(1))).collect()
    assert len(rows) == awkward.count() and all(r["spans"] == [] for r in rows if r["doc_id"] != 9)
    assert S.find_secrets(nothing).count() == 0


def test_query_digest(spark, tmp_path):
    secret = "password = 'hunter2hunter2' " + "ab" * 20
    spark.createDataFrame([(1, secret), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op3_secret_scan"](spark, str(tmp_path)).collect()}
    spans = S.scan(secret)
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 0, 1)
    assert got[1]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans) and got[1]["base_sha256"] == S.span_digest(spans)
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == S.span_digest([])

import random

import pytest

from orbitloom.llm.line_windows import dedup_lines
from orbitloom.llm.url_rules import judge_urls


def brute_lines(rows):
    """rows sorted by id: the first occurrence of each three-line window stays."""
    seen, out = set(), {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0)
            continue
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def test_lines_are_those_of_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))) for i in range(60)] + [(99, None), (100, "")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), kept="kept_text").collect()
    assert {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in got} == brute_lines(rows)


def test_every_line_survives_somewhere(spark):
    rows = [(1, "a\na\na\na\na"), (2, "a\nb\nc\nd"), (3, "x\nb\nc\nd\ny")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set("\n".join(r["text"] for r in got).split("\n")) == set("abcdxy")


def test_line_plans_are_native(spark, awkward):
    plan = dedup_lines(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_awkward_lines(spark, awkward, nothing):
    got = dedup_lines(awkward.selectExpr("doc_id", "text", "1 AS a", "2 AS position", "3 AS doc", "4 AS starts").drop("doc", "starts"))
    assert got.count() == awkward.count() and {r["n_removed"] for r in got.collect()} == {0}
    same = spark.createDataFrame([(1, "p\nq\nr"), (1, "p\nq\nr"), (None, "p\nq\nr"), (2, "p\nq\nr\ns")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in dedup_lines(same).collect()) == [(0, "p\nq\nr"), (1, ""), (1, ""), (2, "s")]
    long = spark.createDataFrame([(1, "\n".join(map(str, range(30_000)))), (2, "\n".join(map(str, range(30_000))))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in dedup_lines(long).collect()} == {1: 0, 2: 30_000}
    assert dedup_lines(nothing).count() == 0


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute_url(url, rules, default="allow"):
    tail = url.partition("://")[2] if url and "://" in url else ""
    cut = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
    host, path = tail[:cut].translate(str.maketrans(UPPER, LOWER)), tail[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    label, step = ["com", "net", "a", "b-c", "a-b", "ab", "X"], ["/", "/en/", "/en", "/e", "en/x", "", "/ü/"]
    host = lambda: ".".join(rng.choice(label) for _ in range(rng.randrange(1, 5)))
    rules = list({(h.lower(), p): (h.lower(), p, rng.choice(["allow", "block"])) for h, p in ((host(), rng.choice(step)) for _ in range(40))}.values())
    urls = [f"{rng.choice(['http', 'https'])}://{host()}{rng.choice(step)}{rng.choice(['', 'x', '?q=/en/', '#/en/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://a.com/en/", "http://a.com?x://net/", "HTTP://COM/EN/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_awkward_pages(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("COM", "/x", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "h", "k"), (1, "http://a.com/", "h", "k"), (None, None, "h", "k"), (2, "http://a.com/" + "x" * 50_000, "h", "k")], "page_id long, url string, host string, key string")
    got = judge_urls(pages, rules).collect()
    by = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in got]
    assert by.count((1, "a.com", "com/", "block")) == 2 and (None, "", None, "allow") in by and (2, "a.com", "com/x", "allow") in by
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_names_used_inside_are_free_for_input_columns(spark):
    names = ["doc", "version", "starts", "_n", "_lines", "_runs", "_left", "n", "lines", "runs", "left", "row", "of", "hash", "whole", "a", "b", "position"]
    docs = spark.createDataFrame([(1, "p\nq\nr"), (2, "p\nq\nr\ns")], "doc_id long, text string").selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *names, "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["n_removed"], r["starts"], r["_runs"]) for r in got.collect()) == [(1, "p\nq\nr", 0, 2, 5), (2, "s", 3, 2, 5)]
    pages = spark.createDataFrame([(1, "https://a.com/x")], "page_id long, url string").selectExpr(
        "*", "1 AS won", "2 AS row", "3 AS rule_key", "4 AS key", "5 AS prefix", "6 AS level", "7 AS path")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    row = judge_urls(pages, rules).first()
    assert (row["won"], row["row"], row["rule_key"], row["rule"], row["verdict"], row["path"]) == (1, 2, 3, "com/", "block", "/x")

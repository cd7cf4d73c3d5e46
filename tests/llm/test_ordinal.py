import random

import numpy as np
import pytest

from orbitloom.llm import ordinal as O
from orbitloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    n, d = 4_000, 3
    x = rng.normal(size=(n, d))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=n)
    y = np.searchsorted([-1.0, 0.5, 2.0], z)
    rows, cols = np.repeat(np.arange(n), d), np.tile(np.arange(d), n)
    w, t = O.fit_cumulative(rows, cols, x.ravel(), y, d, 4, l2=0.0, steps=800)
    assert w == pytest.approx([2.0, -1.0, 0.0], abs=0.2) and t == pytest.approx([-1.0, 0.5, 2.0], abs=0.25)
    assert (np.diff(t) > 0).all()


def test_features_do_not_depend_on_grouping(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab *!|\nZ0é") for _ in range(rng.randrange(0, 80))) for _ in range(50)] + ["", None]
    for kind in O.KINDS:
        def table():
            out = []
            for lo, _, rows, buckets, n in O._counted(pa.array(texts), kind):
                out += [(lo + r, b, c) for r, b, c in zip(*O._pairs(rows, buckets), strict=True)]
            return out
        whole = table()
        with monkeypatch.context() as m:
            m.setattr(O, "row_groups", lambda offsets, size: ((i, i + 1) for i in range(len(offsets) - 1)))
            assert table() == whole


@pytest.fixture(scope="module")
def parts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = {r["doc_id"]: r for r in labels.where("doc_id % 4 = 0").collect()}
    return docs, labels.where("doc_id % 4 <> 0"), held


def test_toxicity_on_held_out_labels(parts):
    docs, labels, held = parts
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect() if r["doc_id"] in held}
    rejected = {i for i, r in got.items() if r["rejected"]}
    toxic = {i for i in got if held[i]["toxic"] == 1}
    assert len(rejected & toxic) >= 0.8 * len(toxic)
    assert len(rejected - toxic) <= 0.01 * (len(got) - len(toxic))
    assert (np.diff(model.thresholds) > 0).all() and all(0 <= r["expected_severity"] <= 3 for r in got.values())
    mean = lambda ids: np.mean([got[i]["expected_severity"] for i in ids])
    assert mean(toxic) > 10 * mean(set(got) - toxic)


def test_quality_on_held_out_labels(parts):
    docs, labels, held = parts
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect() if r["doc_id"] in held}
    good = {i for i in got if held[i]["quality"] == 1}
    selected = {i for i, r in got.items() if r["selected"]}
    assert len(selected & good) >= 0.98 * len(good) and len(selected - good) <= 0.05 * (len(got) - len(good))
    assert all(r["p_usable"] >= r["p_good"] for r in got.values())


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (5, 1, None), (None, 1, 1), (9, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.train(awkward, labels)
        rows = module.score(awkward.selectExpr("doc_id", "text", "1 AS grade"), model).collect()
        assert len(rows) == awkward.count()
        assert module.score(nothing, model).count() == 0
        for few in (labels.limit(0), labels.where("doc_id = 9")):
            assert module.score(awkward, module.train(awkward, few)).count() == awkward.count()
        assert module.score(awkward, module.train(nothing, labels)).count() == awkward.count()
    wide = awkward.selectExpr("doc_id", "text", "1 AS grade", "2 AS quality")
    kept = toxicity.drop_toxic(wide, toxicity.train(awkward, labels.limit(0)))
    assert kept.columns == wide.columns and kept.count() == wide.count()

"""The pipeline against its stages' own brute-force rules, on planted documents."""

import random

import corpus_pipeline as P
from orbitloom.llm import toxicity


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    clean = [text(80) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100 + i, f"{text(30)} {rng.choice(['vile', 'nasty'])} vile nasty {text(30)}") for i in range(20)]  # toxic
    docs += [(200, clean[0]), (201, clean[1] + " more")]  # an exact and a near copy
    item = text(25)
    docs += [(300, f"{text(40)} {item} {text(40)}")]
    passage = "\n".join(text(20) for _ in range(4))
    docs += [(400, passage + "\n" + clean[2][:50]), (401, text(50) + "\n" + passage)]
    docs += [(402, passage)]  # nothing but a passage that stands elsewhere
    docs += [(500, None), (501, "")]
    path = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in docs if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    seen = {}
    current = frame
    for name, stage in P.STAGES:
        current = stage(spark, current, path)
        seen[name] = {r["doc_id"] for r in current.select("doc_id").collect()}
        if name == "line_dedup":
            rows = {r["doc_id"]: r for r in current.collect()}
            assert passage in rows[400]["text"] and passage.split("\n")[1] not in rows[401]["text"]
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows.values())
        if name != P.STAGES[-1][0]:
            assert current.columns == P.COLUMNS
    everyone = {i for i, _ in docs}
    assert seen["toxicity"] == everyone - set(range(100, 120))
    assert seen["line_dedup"] == seen["toxicity"] - {402}  # the cut leaves nothing of it; texts that were empty stay
    assert seen["near_dedup"] == seen["line_dedup"] - {200, 201}
    assert seen["decontamination"] == seen["sentencepiece"] == seen["near_dedup"] - {300}
    final = P.run(spark, path).collect()
    assert {r["doc_id"] for r in final} == seen["sentencepiece"] and all(r["restored"] for r in final)
    assert toxicity.CUTOFF < 0.5


def test_batches_of_texts_are_bounded_by_bytes(spark, tmp_path):
    """Each stage that hands texts to Python takes them 2 MB at a time, however many rows that are."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"size": pa.array([b.nbytes], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = spark.range(0, 4_000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 5000) AS text")
    for stage, run in P.STAGES:
        spark.conf.unset(name)
        if stage != "line_dedup":  # without Python
            run(spark, docs, str(tmp_path))
            assert max(r["size"] for r in long.mapInArrow(sizes, "size long").collect()) < 3 << 20, stage
    spark.conf.unset(name)

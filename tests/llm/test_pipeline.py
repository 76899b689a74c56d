"""The corpus pipeline and its stages on a small table with copies, nulls and clashing columns."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, gone int"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3 + rng.randrange(6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rng.choice([20, 60, 150])) for _ in range(60)]
    passage, line = prose(12), prose(15)
    texts[1] = texts[0]  # an exact copy
    texts[3] = texts[2] + " " + word()  # a near copy, or a near line
    texts[4] += " " + passage + " " + prose(5)
    texts[5], texts[6] = prose(80) + "\n" + line, prose(80) + "\n" + line
    made = [(k, t, "en", f"s{k % 3}", len(t), "x", 1) for k, t in enumerate(texts)] + [(60, None, None, None, None, None, None), (61, "", "en", "s1", 0, "x", 1)]
    docs = spark.createDataFrame(made, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    here = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        there = stage(spark, here, str(tmp_path))
        assert there.columns == docs.columns, name
        there.write.parquet(f"{tmp_path}/{name}")
        here = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r["doc_id"]: r for r in here.collect()}
    kept = {k: r["text"] for k, r in left.items()}
    assert not kept.get(1) and kept[0] == texts[0]  # the copy's only line went with line dedup
    assert passage not in kept[4] and kept[5].endswith(line) and line not in kept[6]
    assert all(kept[k] == texts[k] for k in range(7, 60))  # clean documents are left alone
    assert left[7]["rid"] == "x" and left[7]["gone"] == 1
    mixed = corpus_pipeline.STAGES[-1][1](spark, here, str(tmp_path))
    assert mixed.count() > 0 and mixed.where(F.col("doc_id").isNotNull()).join(here, "doc_id", "left_anti").isEmpty()

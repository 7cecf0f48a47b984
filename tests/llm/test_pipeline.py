import random

import corpus_pipeline as pipeline
from quillspark.llm.common import materialize


def test_stages_take_effect_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    en, de = (["".join(rng.choice(a) for _ in range(6)) for _ in range(300)] for a in ("abcdefg", "nopqrst"))
    docs, labels = [], []
    for i in range(300):
        body = rng.choices(en if i % 2 else de, k=60)
        if i % 10 == 0:
            body += ["nasty", "vile"]
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        docs.append((i, " ".join(body), "en" if i % 2 else "de", "s", 1))
    item = " ".join(rng.choices(en, k=30))
    docs += [(1000, "42 !?", "en", "s", 1), (1001, None, None, None, None), (1002, docs[1][1], "en", "s", 1), (1003, f"before {item} after", "en", "s", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    left, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, left, str(tmp_path)))
        assert out.columns == left.columns
        kept[name] = {r["doc_id"] for r in out.collect()}
        left = out
    every = {d[0] for d in docs}
    assert kept["toxicity"] == every - set(range(0, 300, 10))
    assert kept["language_id"] == kept["toxicity"] - {1000, 1001}
    assert kept["near_duplicates"] == kept["language_id"] - {1002}
    assert kept["decontamination"] == kept["near_duplicates"] - {1003}
    pieces = pipeline.STAGES[-1][1](spark, left, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == kept["decontamination"]
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0

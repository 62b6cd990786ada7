"""Stages of the pipeline on a small table."""

import random

import corpus_pipeline
import __spark_entry__
from tests.llm.conftest import prose


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(12)
    line = prose(rng, 20)
    texts = [f"{prose(rng, 60)}\n{line}" for _ in range(40)]
    texts += [texts[0], texts[1].replace("a", "a", 1), "", "123 456", None]
    table = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near", "mix", "encode"]
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(out.count())
        if name != "encode":
            assert out.columns == docs.columns
        if name == "lines":
            assert out.filter(f"text LIKE '%{line}%'").count() == 1
        docs = out
    # the last holder of the line keeps it, which sets it apart from its copy
    assert sizes[:3] == [42, 42, 41] and docs.columns == ["doc_id", "n_tokens", "ids"]
    assert {"pipeline", *(q for q in __spark_entry__.queries() if q.startswith("op"))} <= set(__spark_entry__.queries())

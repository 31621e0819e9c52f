"""The corpus pipeline end to end; skipped without the training-data subpackage."""

import pytest

pytest.importorskip("tallyweave.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 80]), "en", f"s{i % 3}", 0) for i in range(0, 300, 12)]
    rows += [(1000, rows[0][1], "en", "s0", 0), (1001, rows[3][1] + " end", "en", "s1", 0), (1002, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        assert name == "sentencepiece" or docs.columns == columns
    assert counts[:3] == [28, 27, 26] and counts[3] == counts[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]

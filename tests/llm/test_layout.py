"""Scores of quality don't depend on the input's partitions."""

import random

import numpy as np

from tallyweave.llm import quality


def test_quality_scores_agree_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_SHARE", 60)  # several shares
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("a b c d e f g h".split()) + ("!!" if i % 3 else "") for _ in range(30))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    few, many = (quality.score_quality(frame.repartition(n), labels).toPandas().sort_values("doc_id").score.to_numpy() for n in (2, 200))
    assert np.allclose(few, many, atol=1e-6) and few.std() > 0.1

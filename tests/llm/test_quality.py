"""Quality classifier: the fast score against plain averaging, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import quality
from vellum.llm.shared import fold, table

TEXTS = [None, "", " ", "one", "two two two", "Ä ä word! | | x", "long " * 200_000, "w" * 100_000, "one", "a b a b a b"]


def test_fast_scores_against_averages():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(0, 3, 1 << quality.BITS), -0.4)
    got = model.scores(TEXTS)
    for text, score in zip(TEXTS, got):
        buckets, counts = quality.features(text)
        mean = (model.weight[buckets] * counts).sum() / counts.sum() if len(buckets) else 0.0
        assert score == pytest.approx(1 / (1 + np.exp(-(mean + model.bias))), rel=1e-9)


def test_training_separates():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(200):
        kind = k % 2
        words = [f"{'good' if kind else 'bad'}{rng.integers(50)}" if rng.random() < 0.2 else f"any{rng.integers(300)}" for _ in range(60)]
        rows.append((*quality.features(" ".join(words)), kind))
    model = quality.train(rows)
    assert model.scores(["any1 any2 good99 good77 any3"])[0] > 0.5 > model.scores(["any1 any2 bad99 bad77 any3"])[0]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    held = fold("doc_id", 5) == 0
    model = quality.fit(docs.where(~held), labels.where(~held), "quality")
    scored = quality.score(docs.where(held), model).join(labels, "doc_id")
    right = ((F.col("quality_score") >= 0.3).cast("int") == F.col("quality")).cast("int")
    share, n = scored.agg(F.avg(right), F.count(F.lit(1))).first()
    assert n > 400 and share >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None), (99, 1), (None, 1), (3, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality")
    scores = [r["quality_score"] for r in quality.score(docs, model).collect()]
    assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    none = quality.fit(docs, labels.limit(0), "quality")
    assert quality.score(docs, none).first()["quality_score"] == pytest.approx(0.5)
    assert quality.score(docs.limit(0), none).count() == 0

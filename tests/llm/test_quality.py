import numpy as np
from pyspark.sql import functions as F

from venuelake.llm import quality


def test_additive_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 1] * x[:, 2] > 0).astype(float)  # no feature alone tells it
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    single = quality.fit(x[:2000], (np.abs(x[:2000, 0]) < 0.7).astype(float))
    assert ((single.score(x[2000:]) >= 0.5) == (np.abs(x[2000:, 0]) < 0.7)).mean() > 0.97


def test_held_out_rows_never_teach_and_are_scored_well(spark):
    good, bad = "This is a calm sentence about a quiet town. It goes on for a while.", "BUY!!! $$$ click @@@ ### now now now now %%%"
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(300)] + [(1000, None), (1001, ""), (1, f"{good} 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 AS score", "1 AS quality")
    # labels of the held-out part are wrong: learning from them would show
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    labels = labels.withColumn("quality", F.when(quality.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 300)
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == [0.5, 0.5]
    assert quality.classify(docs.limit(0), labels).count() == 0

"""What the learned operators are worth: held-out accuracy of languages, agreement of quality with labels."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def auc(score, good):
    order = np.argsort(score, kind="stable")
    values, first, counts = np.unique(np.asarray(score)[order], return_index=True, return_counts=True)
    rank = np.repeat(first + (counts + 1) / 2, counts)
    y = np.asarray(good)[order]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_languages_of_held_out_documents(spark):
    from quill.llm.language import language_id

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = language_id(docs).where(F.col("held_out") & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).select((F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    share = np.mean([r["right"] for r in got])
    print("held-out accuracy", round(float(share), 4), "of", len(got))
    assert len(got) > 150 and share > 0.95


def test_quality_agrees_with_labels(spark):
    from quill.llm.quality import quality

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = quality(docs).join(spark.read.parquet(f"{DIR}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").select("quality", "posterior", "keep", "good").collect()
    score, good = [r["quality"] for r in rows], [r["good"] for r in rows]
    agree = np.mean([r["keep"] == bool(r["good"]) for r in rows])
    print("AUC", round(auc(score, good), 4), "of the label model", round(auc([r["posterior"] for r in rows], good), 4), "agreement", round(float(agree), 4), "of", len(rows))
    assert auc(score, good) > 0.8 and agree > 0.8


def test_label_model_equals_plain_expectation_maximisation():
    from quill.llm.quality import label_model

    rng = np.random.default_rng(6)
    patterns = np.unique(rng.integers(0, 3, (40, 4)), axis=0)
    counts = rng.integers(1, 60, len(patterns))
    p, right, share = label_model(patterns, counts)
    # the same rounds one pattern, labeller and vote at a time
    q = [(sum(v == 1 for v in row) + 1) / (sum(v == 1 for v in row) + 4 * sum(v == 0 for v in row) + 2) for row in patterns]
    for _ in range(200):
        prior = (sum(a * n for a, n in zip(q, counts)) + 1) / (counts.sum() + 2)
        chance = {}
        for y in (0, 1):
            for j in range(4):
                c = [1.0, 1.0, 1.0]
                for row, a, n in zip(patterns, q, counts):
                    c[row[j]] += n * (a if y else 1 - a)
                for v in range(3):
                    chance[y, j, v] = c[v] / sum(c)
        fresh = []
        for row in patterns:
            x = [np.log(prior if y else 1 - prior) + sum(np.log(chance[y, j, row[j]]) for j in range(4)) for y in (0, 1)]
            fresh.append(1 / (1 + np.exp(-np.clip(x[1] - x[0], -30, 30))))
        done = max(abs(a - b) for a, b in zip(q, fresh)) < 1e-9
        q = fresh
        if done:
            break
    assert np.allclose(p, q, atol=1e-6) and abs(share - prior) < 1e-6

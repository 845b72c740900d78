"""The classifier: updates against a plain loop, held-out accuracy, sparse scores against dense ones, awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.llm import quality_model as m

SF = "/root/testdata/sf0.01"


def test_updates_follow_the_formula():
    r = np.random.default_rng(1)
    model = m.Ftrl(np.zeros(9), np.zeros(9), 0.7, 1.0, 0.05, 0.01)
    z, n, w = [0.0] * 9, [0.0] * 9, [0.0] * 9
    for _ in range(60):
        at = np.sort(r.choice(9, 4, replace=False))
        x, y = r.random(4), float(r.random() < 0.5)
        model.update(at, x, y)
        for i in at:
            w[i] = 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + 0.01)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_features_are_of_ascii_blanks_and_shares_sum_up():
    f = m.Features(12)
    assert len(f.of("")) == 0 and len(f.of("a")) == 2 and len(f.of("a b")) == 2 + 1 + 2 + 1
    assert len(f.of("a\xa0b")) == 2 and (f.of("A b\tc") == f.of(" A\x0bb\nc ")).all()
    at, x = f.weighed("one two two three", 12)
    assert at[-1] == 1 << 12 and x[-1] == 1 and math.isclose(x[:-1].sum(), m.SCALE) and len(set(at)) == len(at)


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return docs, labels, held, m.fit(docs, labels, ~held)


def test_held_out_accuracy(learned):
    docs, labels, held, weights = learned
    rows = m.score(docs, weights).join(labels, "doc_id").where(held).select("score", "quality").collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)


def test_same_weights_whatever_the_partitions_and_no_learning_from_held_out(spark, learned):
    docs, labels, held, weights = learned
    labels = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = m.fit(docs.repartition(5), labels.repartition(3), ~held)
    assert np.allclose(weights, again)


def test_scores_are_dot_products(spark, learned):
    _, _, _, weights = learned
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "And", "x!!", "a$$$", "|"]) for _ in range(n)) for n in (0, 1, 2, 3, 50, 20_000)] + [None, " \n", "日本 語"]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("h", F.lit(1))
    f = m.Features()
    for row in m.score(docs, weights).collect():
        at, x = f.weighed(row["text"] or "", m.BITS)
        assert math.isclose(row["score"], 1 / (1 + math.exp(-(weights[at] @ x))), rel_tol=1e-9)


def test_no_rows_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in m.classify(docs, none).collect()} == {0.5}
    assert m.classify(docs.limit(0), none).collect() == []
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id long, quality int")
    got = m.labelled_sample(docs.union(docs), odd, None, 10, 2, "doc_id", "text", "quality").collect()
    assert [(r["id"], r["label"], r["text"]) for r in got] == [(1, 0, "a")]

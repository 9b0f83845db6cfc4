import random
import zlib

import numpy as np

from blockloom.llm import quality


def corpus(spark, prose_text, n=1200):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        text, bad = prose_text(rng.randint(5, 200), i), rng.random() < 0.3
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else text.replace(" ", "$$$ ")
        docs.append((i, text, "s"))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(docs, "doc_id long, text string, predicted string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark, prose_text):
    docs, labels = corpus(spark, prose_text)
    model = quality.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score(docs, model).withColumn("out", quality.held_out(quality.F.col("doc_id"))).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_read(spark, prose_text):
    docs, labels = corpus(spark, prose_text, 400)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.allclose(a.weights, b.weights) and a.shift == b.shift


def test_awkward(awkward, nothing, spark):
    labels = spark.createDataFrame([(5, 1), (8, 1), (11, 0), (0, None), (None, 1), (5, 1), (12, 7)], "doc_id long, quality int")
    rows = quality.score(awkward, quality.train(awkward, labels)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.train(awkward, labels.limit(0))
    assert {r.predicted for r in quality.score(awkward, none).collect()} == {1}
    bad = quality.train(awkward, labels.filter("quality = 0"))
    assert {r.predicted for r in quality.score(awkward, bad).collect()} <= {0, 1}
    assert quality.score(nothing, none).count() == 0

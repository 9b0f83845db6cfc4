"""Quality scores from preference pairs (Bradley-Terry).

Among labelled documents each pair (good, bad) says that the good one is preferred. The probability of that is the
logistic function of the difference of two scores, and a score is linear in features of the text alone: shares of
character classes, lengths, and repetition of words and lines. Weights minimise the logistic loss on feature
differences, by Newton steps. The threshold is the score quantile of the labelled documents that tells them best apart;
scores are shifted so that it lies at THRESHOLD, and squashed to 0..1.

Training reads at most TRAIN_ROWS labelled rows (the smallest hashes of their ids) and PAIRS pairs, both documented
bounds; rows with crc32(doc_id) mod 4 = 2 are never read for training. Every document is scored, from its whole text.

Cases: null and empty texts have features like any other; null labels or ids are not learnt from; repeated rows score
alike; without a good or without a bad label nothing can be learnt, and all scores are 1 (0 if all labels are bad); an
empty table gives an empty table; input columns named score or predicted are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TRAIN_ROWS, PAIRS, RIDGE, THRESHOLD = 20_000, 100_000, 1e-3, 0.7
FEATURES = 26


def features(text: str):
    """Numbers that describe a text; shares are of its bytes, words or lines."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1.0, float(len(raw)))
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    upper, lower = count[65:91].sum(), count[97:123].sum()
    marks = [count[ord(c)] for c in ".,!?#$%&*|"]
    used = upper + lower + count[48:58].sum() + sum(marks) + count[[9, 10, 13, 32]].sum() + count[128:].sum()
    long_lines = [x for x in lines if len(x) > 20]
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), n / w, upper / n, upper / max(1.0, upper + lower), lower / n,
        count[48:58].sum() / n, count[128:].sum() / n, count[32] / n, count[10] / n, *[m / w for m in marks], (n - used) / n,
        len(set(words)) / w, np.log(len(set(words)) + 1) / np.log(w + 1.5), len(set(lines)) / len(lines),
        len(set(long_lines)) / max(1, len(long_lines)), min(200, max(map(len, words), default=0)) / 20,
    ])


@dataclass
class Model:
    mean: object
    scale: object
    weights: object
    shift: float

    def score(self, x):
        import numpy as np

        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(x, y, seed: int = 5) -> Model:
    """A model from features x and labels y (1: good)."""
    import numpy as np

    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), -500.0 if len(bad) else 500.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = RIDGE * w - d.T @ p / len(d)
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    s, right = raw[order], y[order]
    # Errors if the first i of the order are called bad; the best quantile lies halfway to the next score.
    errors = np.concatenate([[0], np.cumsum(right == 1)]) + np.concatenate([np.cumsum((right == 0)[::-1])[::-1], [0]])
    i = int(np.median(np.flatnonzero(errors == errors.min())))
    cut = s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else (s[i - 1] + s[i]) / 2
    return Model(mean, scale, w, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def run(batch) -> list:
        x = np.stack([features(t) for t in common.text_of(batch, "text")]) if batch.num_rows else np.zeros((0, FEATURES))
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))]

    return common.map_batches(docs, run, [T.StructField("x", T.ArrayType(T.DoubleType()))], keep)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    import numpy as np

    usable = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS at most
    found = with_features(rows, ["y"]).collect()
    x = np.array([r["x"] for r in found]).reshape(-1, FEATURES)
    return fit(x, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted (1 if score is THRESHOLD or more)."""
    import numpy as np
    import pyarrow as pa

    def run(batch) -> list:
        x = np.stack([features(t) for t in common.text_of(batch, "text")]) if batch.num_rows else np.zeros((0, FEATURES))
        s = model.score(x)
        return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return common.map_batches(docs, run, fields, keep)

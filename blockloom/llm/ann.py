"""Approximate nearest neighbours with learned partitions.

A bounded sample of vectors (SAMPLE_ROWS, the smallest hashes of their ids) is joined into a neighbour graph. The graph
is cut into balanced parts by recursive spectral bisection at the median, refined by swaps that lower the cut. A softmax
classifier learns the parts, and every row of the table is indexed under its most probable part. A query visits as many
of its most probable parts as held-out rows of the sample need for the wanted recall, but so many at least that they hold
k vectors besides its own, and all vectors there are reranked exactly.

Nearness is the inner product, computed in double precision, component by component, so equal vectors score equally.
For the graph, vectors of unequal norms get one more component that makes all norms equal.

Each vector length has an index of its own. Large parts are dealt into blocks by a hash of the id, so one very common
vector doesn't meet in one task. The sample gives the number of parts, PART_ROWS of its rows each at least, for tables of
any size; larger tables have larger parts, with more blocks.

Cases: vectors null, zero or empty, or with null or non-finite components take no part, nor do rows with a null id; a
query is compared with vectors of its own length only; rows with the query's id count as its own; query rows of one id
count once; repeated candidate rows are all candidates; ties go to the smaller id; very long vectors are vectors like
others; other columns are ignored; empty input, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .topk import ranked, usable

#: The sample that the index is fitted on; its rows per part at least and most parts; vectors in a block and queries in a block.
SAMPLE_ROWS, PART_ROWS, MOST_PARTS, BLOCK_ROWS, QUERY_ROWS = 6144, 64, 64, 4096, 2048
LOCAL = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def neighbour_graph(points, k: int = 10):
    """Edges (from, to) of the k nearest by inner product of points with equal norms."""
    import numpy as np

    k = min(k, len(points) - 1)
    ends = []
    for at in range(0, len(points), 512):
        near = points[at : at + 512] @ points.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        ends.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.repeat(np.arange(len(points)), k), np.concatenate(ends).ravel()


def halves(n: int, a, b, rng):
    """A balanced cut of a graph of n nodes: True for one half."""
    import numpy as np

    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=n) + 1e-9
    root = np.sqrt(degree)
    x = rng.standard_normal(n)
    trivial = root / np.linalg.norm(root)
    for _ in range(60):
        x -= trivial * (trivial @ x)
        x = 0.5 * (x + np.bincount(a, weights=x[b] / root[b], minlength=n) / root)
        x /= np.linalg.norm(x) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[: n // 2]] = True
    for _ in range(8):
        other = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * other - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swap = int(np.count_nonzero(gain[left[:m]] + gain[right[:m]] > 0)) // 2
        if swap == 0:
            break
        side[left[:swap]], side[right[:swap]] = False, True
    return side


def balanced_parts(n: int, a, b, parts: int, seed: int = 11):
    import numpy as np

    rng = np.random.default_rng(seed)
    label, count = np.zeros(n, np.int64), 1
    while count < parts:
        fresh = np.zeros(n, np.int64)
        for p in range(count):
            own = np.flatnonzero(label == p)
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            inside = (at[a] >= 0) & (at[b] >= 0)
            fresh[own] = 2 * p + halves(len(own), at[a[inside]], at[b[inside]], rng) if len(own) > 1 else 2 * p
        label, count = fresh, count * 2
    return label


def fit_softmax(points, label, parts: int, steps: int = 300):
    """Weights of a softmax classifier, by Adam on the whole sample."""
    import numpy as np

    x = np.concatenate([points, np.ones((len(points), 1))], 1)
    w = np.zeros((x.shape[1], parts))
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(parts)[label]
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


class Router:
    """Ranks the parts of vectors by the classifier's probability."""

    def __init__(self, points, k: int, recall: float) -> None:
        import numpy as np

        norms = np.linalg.norm(points, axis=1)
        self.scale = float(norms.max()) or 1.0
        unit = points / self.scale
        rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        level = np.concatenate([unit, rest[:, None]], 1) if rest.max() > 1e-3 else unit
        self.parts = 1
        while self.parts < MOST_PARTS and len(points) >= 2 * PART_ROWS * self.parts:
            self.parts *= 2
        self.probes = 1
        self.weights = np.zeros((points.shape[1] + 1, self.parts))
        if self.parts == 1:
            return
        # Every fifth row of the sample is held out: it has no place in the graph and asks for its neighbours afterwards.
        asks = np.arange(0, len(points), 5)
        learn = np.delete(np.arange(len(points)), asks)
        a, b = neighbour_graph(level[learn])
        label = balanced_parts(len(learn), a, b, self.parts)
        self.weights = fit_softmax(unit[learn], label, self.parts)
        # Probes: the fewest that reach the wanted recall for these, whose nearest in the sample stand for the table's.
        asks = asks[:: max(1, len(asks) // 1024)]
        near = points[asks] @ points.T
        near[np.arange(len(asks)), asks] = -np.inf
        kk = min(k, len(points) - 1)
        top = np.argpartition(-near, kk - 1, axis=1)[:, :kk]
        order = self.order(points)
        home, place = order[:, 0], np.argsort(order[asks], axis=1)
        needed = np.sort(place[np.arange(len(asks))[:, None], home[top]].ravel())
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1

    def order(self, points):
        import numpy as np

        z = (points / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.argsort(-z, axis=1, kind="stable")


def rerank(query_ids, queries, cand_ids, cands, k: int):
    """(query id, candidate id, score) of each query's k best candidates, ties to the smaller id."""
    import numpy as np

    out = []
    for at in range(0, len(queries), 256):
        q, ids = queries[at : at + 256], query_ids[at : at + 256]
        rough = q @ cands.T
        rough[ids[:, None] == cand_ids[None, :]] = -np.inf
        kk = min(k, len(cands))
        kth = np.partition(rough, len(cands) - kk, axis=1)[:, len(cands) - kk]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        qi, ci = np.nonzero((rough >= (kth - slack)[:, None]) & np.isfinite(rough))
        score = np.zeros(len(qi))
        for d in range(q.shape[1]):
            score += q[qi, d] * cands[ci, d]
        found = cand_ids[ci]
        order = np.lexsort((found, -score, qi))
        qi, found, score = qi[order], found[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        own = rank < k
        out.append((ids[qi[own]], found[own], score[own]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that the index finds for each query row."""
    spark = vectors.sparkSession
    base = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull() & F.exists(vec_col, lambda x: x != 0))
    base = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    found = spark.createDataFrame([], LOCAL)
    for (dim,) in sorted(tuple(r) for r in base.select(F.size("v")).distinct().collect()):  # one row per vector length
        found = found.unionByName(search_length(base.filter(F.size("v") == dim), dim, k, recall))
    return ranked(found, k)


def fitted(base: DataFrame, k: int, recall: float) -> Router:
    """The router that is fitted on a sample of rows id, v of one length."""
    import numpy as np

    sample = base.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(SAMPLE_ROWS).select("id", "v").collect()
    return Router(np.array([r[1] for r in sample], dtype=np.float64), k, recall)


def search_length(base: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    """query_id, vec_id, score of what an index of rows id, v, asks finds; all v have length dim."""
    import numpy as np

    router = fitted(base, k, recall)

    def route(batch) -> list:
        import pyarrow as pa

        v = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
        order = router.order(v)
        ranked_parts = [row.tolist() if ask else [] for row, ask in zip(order, batch.column(2).to_pylist(), strict=True)]
        return [pa.array(order[:, 0], pa.int32()), pa.array(ranked_parts, pa.list_(pa.int32()))]

    fields = [T.StructField("home", T.IntegerType()), T.StructField("parts", T.ArrayType(T.IntegerType()))]
    routed = common.saved(common.map_batches(base, route, fields), "routed")
    # One row per part: MOST_PARTS at most.
    sizes = {r[0]: (r[1], r[2]) for r in routed.groupBy("home").agg(F.count(F.lit(1)), F.count_if("asks")).collect()}
    blocks = [max(1, -(-sizes.get(p, (0, 0))[0] // BLOCK_ROWS)) for p in range(router.parts)]
    asked = sum(x[1] for x in sizes.values())
    qblocks = max(1, -(-asked // QUERY_ROWS))
    block_count = F.element_at(F.array(*[F.lit(x) for x in blocks]), F.col("part") + 1)
    keys = ("part", "block", "qblock")

    cands = routed.select("id", "v", F.col("home").alias("part"))
    cands = cands.withColumn("block", F.pmod(F.xxhash64("id"), block_count).cast("int")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    # A query goes through its parts until they hold k vectors besides the rows of its own id.
    own = routed.groupBy("id").agg(F.min(F.when(F.col("asks"), F.struct("v", "parts"))).alias("q"), F.count(F.lit(1)).alias("own")).filter("q IS NOT NULL")
    held = F.array(*[F.lit(sizes.get(p, (0, 0))[0]).cast("long") for p in range(router.parts)])
    upto = lambda j: F.aggregate(F.slice("parts", 1, j), F.lit(0).cast("long"), lambda n, p: n + F.element_at(held, p + 1))
    enough = F.filter(F.sequence(F.lit(router.probes), F.lit(router.parts)), lambda j: upto(j) >= k + F.col("own"))
    asks = own.select("id", "q.*", "own").withColumn("visits", F.coalesce(F.get(enough, 0), F.lit(router.parts)))
    asks = asks.select("id", "v", F.explode(F.slice("parts", F.lit(1), F.col("visits"))).alias("part"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), block_count - 1))).withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(qblocks)).cast("int"))

    def local(key, queries, found):
        import pandas as pd

        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        out = rerank(queries["id"].to_numpy(), np.stack(queries["v"]), found["id"].to_numpy(), np.stack(found["v"]), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    return asks.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(local, LOCAL)

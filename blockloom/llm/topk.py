"""Exact top-k inner products with one KD-tree per shard.

Candidates are dealt by a hash of their id into shards of a bounded size. In each shard a KD-tree splits at the median
of the widest dimension, down to leaves with tight bounding boxes. A query visits the leaves best first, by the largest
inner product that the leaf's box allows, and stops when no box can reach its k-th score. The k-th score of a first
pilot shard is propagated to all other shards as their starting bound. Pruning never changes a result.

Vectors are turned into integers floor(scale * x), so scores are exact: as doubles or longs where these hold all sums,
as integers of any size elsewhere. A score that doesn't fit a long is an error.

Cases: null vectors and vectors with null or non-finite components take no part, nor do rows with a null id; empty vectors
do, with score 0; a query is compared with vectors of its own length only; rows that carry the query's id count as its
own; several query rows of one id count once (the smallest vector); repeated candidate rows are all candidates; ties go to
the smaller id; very long vectors are vectors like others; other columns are ignored; empty input, empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Candidates in a shard, queries in a block, vectors in a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 2048, 128
LOCAL = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vectors, scale: int):
    """floor(scale * x) of every component: as doubles where they are exact and small enough, else as Python's integers."""
    import numpy as np

    with np.errstate(over="ignore"):
        found = np.floor(vectors * float(scale))
    if np.abs(found).max(initial=0) < 2**53:
        return found
    whole = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(vectors.shape)


def build_tree(points, leaf_rows: int = LEAF_ROWS) -> list:
    """Row numbers of each leaf after median splits of the widest dimension."""
    import numpy as np

    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) > leaf_rows:
            own = points[rows]
            spread = own.max(0) - own.min(0)
            wide = int(spread.argmax()) if len(spread) else 0
            if len(spread) and spread[wide] > 0:
                order = np.argsort(own[:, wide], kind="stable")
                half = len(rows) // 2
                todo += [rows[order[:half]], rows[order[half:]]]
                continue
            # Equal vectors can't be split: the tree cuts them by row, with equal boxes.
            todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            continue
        leaves.append(rows)
    return leaves


def best(scores, ids, k: int):
    """The k best columns of each row: larger score first, then smaller id."""
    import numpy as np

    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def exact_integers(numbers):
    """Whole numbers of any type as Python's integers."""
    import numpy as np

    out = np.empty(numbers.size, object)
    out[:] = [int(x) for x in numbers.ravel().tolist()]
    return out.reshape(numbers.shape)


def search_shard(query_ids, queries, bounds, cand_ids, cands, k: int):
    """(query row, candidate id, score) of each query's k best in this shard that reach its bound."""
    import numpy as np

    largest = [float(np.abs(x).max(initial=0)) for x in (queries, cands)]
    bound = largest[0] * largest[1] * queries.shape[1]
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 and max(largest) < 2**62 else object
    q, c = (x if x.dtype == kind else exact_integers(x) if kind is object else x.astype(kind) for x in (queries, cands))
    leaves = build_tree(cands)
    low = np.stack([cands[r].min(0) for r in leaves]).astype(np.float64)
    high = np.stack([cands[r].max(0) for r in leaves]).astype(np.float64)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    # Rounded sums err in proportion to the sizes of their terms.
    reach = up @ high.T + down @ low.T + 1e-12 * (up @ np.abs(high).T - down @ np.abs(low).T)
    visit = np.argsort(-reach, axis=1, kind="stable")
    none = np.iinfo(np.int64)
    top_s = np.full((len(q), k), none.min + 1, np.int64)
    top_i = np.full((len(q), k), none.max, np.int64)
    for step in range(len(leaves)):
        leaf = visit[:, step]
        kth = np.maximum(top_s[:, -1], bounds)
        active = np.flatnonzero(reach[np.arange(len(q)), leaf] >= kth)
        if not len(active):
            break
        for which in np.unique(leaf[active]):
            own, rows = active[leaf[active] == which], leaves[which]
            scores = q[own] @ c[rows].T
            ids = np.broadcast_to(cand_ids[rows], scores.shape)
            mine = ids == query_ids[own][:, None]
            if kind is object:
                scores[mine] = 0
                if scores.size and (scores.max() > none.max or scores.min() <= none.min + 1):
                    raise OverflowError("a score doesn't fit a long")
            scores = np.rint(scores).astype(np.int64) if kind is np.float64 else scores.astype(np.int64)
            skip = mine | (scores < bounds[own][:, None])
            scores, ids = np.where(skip, none.min + 1, scores), np.where(skip, none.max, ids)
            top_s[own], top_i[own] = best(np.concatenate([top_s[own], scores], 1), np.concatenate([top_i[own], ids], 1), k)
    rows, cols = np.nonzero(top_s > none.min + 1)
    return query_ids[rows], top_i[rows, cols], top_s[rows, cols]


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row, over all rows."""
    spark = vectors.sparkSession
    base = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    base = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    base = base.withColumn("dim", F.size("v"))
    rows, asked = base.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, -(-rows // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))

    cands = base.select("dim", "id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    asks = base.filter("asks").groupBy("dim", "id").agg(F.min("v").alias("v")).withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int"))

    def local(key, queries, found):
        import numpy as np
        import pandas as pd

        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        bounds = queries["bound"].fillna(np.iinfo(np.int64).min + 1).to_numpy(np.int64)
        q, c = (integers(np.stack(x["v"]).astype(np.float64), scale) for x in (queries, found))
        out = search_shard(queries["id"].to_numpy(), q, bounds, found["id"].to_numpy(), c, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    keys = ("dim", "shard", "qblock")

    def against(queries: DataFrame, first: int, last: int) -> DataFrame:
        q = queries.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        c = cands.filter(F.col("shard").between(first, last)).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(local, LOCAL)

    pilot = common.saved(against(asks.withColumn("bound", F.lit(None).cast("long")), 0, 0), "pilot")
    found = pilot
    if shards > 1:
        kth = pilot.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
        bounded = common.saved(asks.join(kth, "id", "left"), "bounded")
        found = pilot.unionByName(against(bounded, 1, shards - 1))
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

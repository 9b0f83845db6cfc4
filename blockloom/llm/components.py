"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tasks that the neighbours of one node are dealt to where they meet the node's smallest neighbour.
SALT = 8
#: Edges, by a count of them, that one task of an executor resolves by itself (16 bytes each); more go round by round.
ONE_TASK = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) joined with least (u, m); a node of very many edges is spread over SALT tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>"))), ["u", "salt"]).drop("salt")


def _in_one_task(edges: DataFrame) -> DataFrame:
    """id, root of a table of at most ONE_TASK edges."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = place[: len(u)], place[len(u) :]
        label = np.arange(len(ids))
        while True:
            # Each root takes the smallest root that an edge leads to, then all point to their roots.
            least = np.minimum(label[a], label[b])
            after = label.copy()
            np.minimum.at(after, label[a], least)
            np.minimum.at(after, label[b], least)
            while True:
                jumped = after[after]
                if (jumped == after).all():
                    break
                after = jumped
            after = after[label]
            if (after == label).all():
                break
            label = after
        moved = label != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["id", "root"])

    return edges.coalesce(1).mapInArrow(run, "id long, root long")


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id that it is connected with) for every id in edges (u, v) but the roots themselves.

    Each round sends every node's neighbours to the smallest one it knows: two aggregations with map-side minima and two
    joins, dealt by node and a salt. Rounds go on until nothing changes; their number grows with the logarithm of the
    longest path. A table of at most ONE_TASK edges is resolved in one task, with the same result.
    """
    edges = common.saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.count() <= ONE_TASK:
        found = common.saved(_in_one_task(edges.select("u", "v")), "components")
        common.drop(edges)
        return found
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.saved(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after_edges = common.saved(small.distinct(), "small")
        after = _state(after_edges)
        common.drop(large, edges)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))

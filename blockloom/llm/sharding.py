"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks (a hash of the row's id). How many rows go from each block to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation of all rows implies: block totals and shard totals are exact.
Then each block permutes its rows and deals them out by the drawn counts, rows are exchanged, and each shard permutes
what it got. All of it is DataFrame operations: sorts by keyed hashes permute, running sums turn counts into positions.

Blocks grow in number with the table, so a window holds about BLOCK_ROWS rows; MOST_BLOCKS bounds the matrix that is
broadcast, so above MOST_BLOCKS * BLOCK_ROWS rows the blocks grow in size (Spark sorts a window's rows on disk then). A
shard is permuted in buckets drawn by a keyed hash, whose sizes are added up, so no task sorts a shard.

Cases: a null text has size 1 and the checksum of no bytes; very long texts are read whole and carried as their size and
checksum; rows that repeat an id and text in full are interchangeable, and spread by their place in the table; a null id is an id like any other; with fewer rows than shards some shards are
empty; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS, BLOCK_ROWS, MOST_BLOCKS = 16, 20_000, 16_384


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Good ones among drawn from an urn: exact inversion, outwards from the mode."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - at_mode
    if u < 0:
        return mode
    left = right = mode
    p_left = p_right = at_mode
    while left > low or right < high:
        if right < high:
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right += 1
            u -= p_right
            if u < 0:
                return right
        if left > low:
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left -= 1
            u -= p_left
            if u < 0:
                return left
        if p_left + p_right < 1e-300:
            break
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts from each block to each shard."""
    rng, left, out = random.Random(seed), list(shard_sizes), []
    for size in block_sizes:
        row, todo, rest = [], size, sum(left)
        for s, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, todo)
            row.append(got)
            todo -= got
            left[s] -= got
        out.append(row)
    return out


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = common.saved(rows.withColumn("name", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("own", F.monotonically_increasing_id()), "sizes")
    # Rows that repeat get a number of their own, so that many of them don't lie in one block.
    often = common.saved(rows.groupBy("name").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("name", F.lit(True).alias("again")), "often")
    rows = rows.join(often, "name", "left").withColumn("name", F.when(F.col("again"), F.xxhash64("name", "own")).otherwise(F.col("name"))).drop("own", "again")
    keyed = F.col("name")
    blocks = max(shards, min(MOST_BLOCKS, -(-rows.count() // BLOCK_ROWS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(keyed, F.lit(seed)), F.lit(blocks)).cast("int"))

    counts = dict(rows.groupBy("block").count().collect())  # one number per block: MOST_BLOCKS at most
    sizes = [counts.get(b, 0) for b in range(blocks)]
    total = sum(sizes)
    matrix = communication_matrix(sizes, [(total + shards - 1 - s) // shards for s in range(shards)], seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    plan = spark.createDataFrame(list(enumerate(ends)), "block int, ends array<long>")

    permuted = Window.partitionBy("block").orderBy(F.xxhash64(keyed, F.lit(seed + 1)), "doc_id", "text_crc32")
    dealt = rows.withColumn("place", F.row_number().over(permuted)).join(F.broadcast(plan), "block")
    shard = F.size(F.filter("ends", lambda e: e < F.col("place")))
    dealt = dealt.select("doc_id", "size", "text_crc32", "name", shard.alias("shard"), F.pmod(F.xxhash64(keyed, F.lit(seed + 2)), F.lit(blocks)).cast("int").alias("bucket"))
    dealt = common.saved(dealt, "dealt")

    inside = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(keyed, F.lit(seed + 3)), "doc_id", "text_crc32")
    placed = dealt.withColumn("rank", F.row_number().over(inside))
    filled = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r between 0 and CAP copies. Among all rates that give each source its target number of words,
the ones nearest to one copy each (in relative entropy, with the cap as a second bound) are exponentially tilted:
    r / (CAP - r) = exp(lambda_s * x) / (CAP - 1),   x = size / mean size of the source.
The multipliers lambda_s minimise a convex dual, one dimension for each source. Newton steps, kept inside a bracket,
solve it over a table of (source, size, documents), which is all that the dual needs to know about the corpus.

Rates are then rounded to copies: floor(r + u), u from a hash of doc_id and text. The rounding's error in a source is
undone by shifting u for the documents that are nearest to flipping, found from a histogram of those distances.

Sources, their targets and multipliers are tables, too, so there may be any number of sources (hosts, say); the driver sees
sums and counts alone. Newton steps go on until every source is solved, or its bracket has no number left inside.

Cases: a null source is a source of its own, the last one; null or empty texts have size 0 and are taken once where
their source is not stopped at 0; very long texts have large sizes, and are otherwise like others; sources without words get
target 0; sources of equal size are told apart by their order alone; repeated rows round alike; an empty table gives an
empty table; only doc_id, source and text are read, so other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order, repeating; the most copies of a document and the most times a source's size.
WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
#: Bins of the distance to a flip, in each source.
BINS = 4096


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the whole by weight, none above cap times its size; what is cut off is reshared by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / weight > cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            return out
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free -= full
    return out


def rate(lam, x):
    """Copies of a document, as a Column: the tilted rate under the cap."""
    return F.lit(float(CAP)) / (1 + (CAP - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, by key in code point order, without bringing them to one task."""
    task = F.spark_partition_id()
    place = F.monotonically_increasing_id() - F.shiftleft(task.cast("long"), 33)
    dealt = common.saved(sources.repartitionByRange("key").sortWithinPartitions("key").withColumn("task", task).withColumn("place", place), "ranked")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = dealt.groupBy("task").agg(F.count(F.lit(1)).alias("rows")).select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return dealt.join(offsets, "task").withColumn("rank", F.col("offset") + F.col("place")).drop("task", "place", "offset")


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: float = CAP) -> DataFrame:
    """Rows key, size, n with their target: as targets(), over a table of sources."""
    order = F.array(*[F.lit(float(w)) for w in weights])
    state = common.saved(ranked(sources).withColumn("weight", F.get(order, (F.col("rank") % len(weights)).cast("int"))).withColumn("target", F.lit(None).cast("double")), "targets")
    while True:
        free = F.col("target").isNull()
        left, weight = state.agg(F.sum(F.col("size").cast("double")) - F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(free, F.col("weight")))).first()
        if weight is None:
            return state
        share = F.lit(left) * F.col("weight") / F.lit(weight)
        full = state.withColumn("target", F.when(free & (share > cap * F.col("size")), cap * F.col("size").cast("double")).otherwise(F.col("target")))
        full = common.saved(full, "targets")
        if full.filter(free).count() == state.filter(free).count():
            out = common.saved(full.withColumn("target", F.coalesce("target", share)), "targets")
            common.drop(state, full)
            return out
        common.drop(state)
        state = full


def solve(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (key, size, n, target) with mean and lam, the multiplier: bracketed Newton steps on all sources at once."""
    target, size = F.col("target"), F.col("size")
    open_ = (size > 0) & (target > 0) & (target < CAP * size * (1 - 1e-9))
    start = F.when(~open_ & (size > 0) & (target > 0), 1e300).otherwise(0.0)
    state = sources.select(
        "key", "size", "target", F.greatest(F.lit(1e-9), size / F.col("n")).alias("mean"), start.alias("lam"),
        F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), open_.alias("open"),
    )
    state = common.saved(state, "state")
    while state.filter("open").limit(1).count():
        joined = histogram.withColumnRenamed("size", "words").join(state.filter("open").select("key", "lam", "mean"), "key").withColumn("x", F.col("words") / F.col("mean"))
        r = rate(F.col("lam"), F.col("x"))
        words = F.col("n") * F.col("words")
        sums = joined.groupBy("key").agg(F.sum(words * r).alias("g"), F.sum(words * F.col("x") * r * (1 - r / CAP)).alias("h"))
        lam, off = F.col("lam"), F.col("g") - F.col("target")
        now = state.join(sums, "key", "left").withColumn("off", off)
        now = now.withColumn("low", F.when(F.col("off") < 0, lam).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, lam).otherwise(F.col("high")))
        low, high = F.col("low"), F.col("high")
        newton = F.when(F.col("h") > 0, lam - F.col("off") / F.col("h"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        closed = (low > -math.inf) & (high < math.inf)
        # Outside the bracket: halve it, or widen an open one.
        to = F.when(inside, newton).when(closed, (low + high) / 2).otherwise(lam * 2 + F.when(F.col("off") < 0, 1.0).otherwise(-1.0))
        done = (F.abs(F.col("off")) <= 1e-9 * F.col("target") + 1e-6) | (closed & ((to <= low) | (to >= high))) | (F.abs(to) > 1e6)
        now = now.withColumn("done", F.coalesce(done, F.lit(True))).withColumn("to", to)
        after = now.select(
            "key", "size", "target", "mean", F.when(F.col("open") & ~F.col("done"), F.col("to")).otherwise(lam).alias("lam"), "low", "high", (F.col("open") & ~F.col("done")).alias("open"),
        )
        after = common.saved(after, "state")
        common.drop(state)
        state = after
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), copies and taken = copies * size.

    keep: input columns to return besides.
    """
    # Duplicate names with other meanings: the operator's own columns replace the input's.
    extra = [c for c in keep or [] if c not in (id_col, "size", "source_size", "target", "copies", "taken")]
    sized = docs.select(
        F.col(id_col).alias(id_col), common.source_key(F.col("source")).alias("key"), common.word_count(F.col("text")).alias("size"),
        (F.pmod(F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col("text"), F.lit("")))), F.lit(1 << 30)) / float(1 << 30)).alias("u"), *extra,
    )
    sized = common.saved(sized, "sized")
    histogram = common.saved(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    found = histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("size"), F.sum("n").alias("n"))
    state = solve(histogram, with_targets(found, weights))
    rated = sized.join(state.select("key", F.col("size").alias("source_size"), "target", "lam", "mean"), "key")
    full = F.col("lam") > 1e200
    r = F.when(full, F.lit(float(CAP))).when(F.col("size") == 0, F.lit(1.0)).otherwise(rate(F.col("lam"), F.col("size") / F.col("mean")))
    rated = rated.withColumn("r", r).withColumn("copies", F.least(F.lit(CAP), F.floor(F.col("r") + F.col("u"))).cast("int"))
    part = F.col("r") + F.col("u") - F.floor(F.col("r") + F.col("u"))
    rated = rated.withColumn("up", F.when((F.col("copies") < CAP) & (F.col("size") > 0) & ~full, F.floor((1 - part) * BINS).cast("int")))
    rated = rated.withColumn("down", F.when((F.col("copies") > 0) & (F.col("size") > 0) & ~full, F.floor(part * BINS).cast("int")))
    shift = common.saved(shifts(rated), "shifts")
    rated = rated.join(shift, "key", "left")
    step = F.when(F.col("up") < F.col("up_to"), 1).when(F.col("down") < F.col("down_to"), -1).otherwise(0)
    copies = (F.col("copies") + step).cast("int")
    return rated.select(id_col, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *extra)


def shifts(rated: DataFrame) -> DataFrame:
    """Per source, how many bins of documents to flip up or down so that its words come nearest to the target."""
    off = rated.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    side = F.when(F.col("off") > 0, F.col("up")).otherwise(F.col("down"))
    # At most BINS rows for each source.
    bins = rated.select("key", "up", "down", "size").join(off, "key").groupBy("key", "off", side.alias("bin")).agg(F.sum("size").alias("words")).filter("bin IS NOT NULL")
    run = Window.partitionBy("key").orderBy("bin")
    bins = bins.withColumn("left", F.abs(F.abs(F.col("off")) - F.sum("words").over(run)))
    best = bins.groupBy("key", "off").agg(F.min(F.struct("left", "bin")).alias("b")).filter(F.col("b.left") < F.abs(F.col("off")))
    flips = F.col("b.bin") + 1
    return best.select("key", F.when(F.col("off") > 0, flips).otherwise(0).alias("up_to"), F.when(F.col("off") > 0, 0).otherwise(flips).alias("down_to"))

"""How five document filters interact: what each removes at each place of every order.

1. One scan turns each text into a mask of the filters that it fails, its length and the hashes of successive blocks.
2. Exact copies are found by refining a partition: rows of one length are a class, which the hashes of successive blocks
   split further; classes of one row are dropped after each split. Only the texts of what is left are compared, in full:
   they meet by class, and equal ones collapse where they are read. Each of them but those of the smallest doc_id fails.
3. Masks are counted per part. All that is asked of the 120 orders follows from these at most 32 counts a part.

Classes are only where texts meet: should different texts share one, its rows are matched by their texts.

Filters (letters as in FILTERS): A fewer than 50 words; B distinct words under 65 percent; C capitals A-Z over 5 percent of
code points; D any of `#$%&*|`; E same text as a smaller doc_id in the whole table.

Cases: a null text is empty (it fails A, and E if a smaller doc_id is empty, too); a null source is the part '', like an
empty one; every row counts, repeated ones, too, but rows of one doc_id are no copies of each other; a null doc_id is
neither smaller nor larger than others and has no labels; labels that are repeated count if any of them is 1; very long
texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
WHITE = " \t\n\x0b\f\r"
#: Where blocks end, in code points; the last block is the rest of the text.
BLOCK_ENDS = (64, 1024)


def failures(text: Column) -> Column:
    """The bits of A to D that a text without nulls fails."""
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, F.lit(100) * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for k, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    return mask


def classes(text: Column) -> list[Column]:
    """The class of a text after each step: by its length, then by one more block each time."""
    starts, out = (0, *BLOCK_ENDS), [F.xxhash64(F.length(text))]
    for k, start in enumerate(starts):
        block = F.substring(text, start + 1, starts[k + 1] - start if k + 1 < len(starts) else (1 << 31) - 1)
        out.append(F.xxhash64(out[-1], block))
    return out


def refined(measured: DataFrame, steps: int) -> DataFrame:
    """The last classes of the rows that are never alone in one, each once."""
    left, old = measured.select(*[f"class{k}" for k in range(steps)]), None
    for k in range(steps):
        shared = left.groupBy(f"class{k}").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(f"class{k}")
        if k == steps - 1:
            return shared
        left = common.saved(left.join(shared, f"class{k}", "left_semi").drop(f"class{k}"), f"classes{k}")
        if old is not None:
            common.drop(old)
        old = left
    return left


def first_ids(docs: DataFrame, measured: DataFrame, steps: int) -> DataFrame:
    """class, the smallest doc_id of its texts, and how many different texts it has."""
    last = f"class{steps - 1}"
    texts = docs.select("doc_id", "text", classes(F.col("text"))[-1].alias(last)).join(refined(measured, steps), last, "left_semi")
    # By text alone: copies collapse where the join has left them, however many share a class.
    equal = texts.groupBy("text").agg(F.min(last).alias(last), F.min("doc_id").alias("first"))
    return common.saved(equal.groupBy(last).agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")), "first-ids")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row."""
    docs = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    steps = classes(F.col("text"))
    last = f"class{len(steps) - 1}"
    measured = common.saved(docs.select("doc_id", "part", failures(F.col("text")).alias("mask"), *[c.alias(f"class{k}") for k, c in enumerate(steps)]), "measured")
    found = first_ids(docs, measured, len(steps))
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    out = measured.join(found.filter("texts = 1"), last, "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), last)
    several = found.filter("texts > 1").select(last)
    if several.isEmpty():
        return out.drop(last)
    # Different texts in one class: their rows are told apart by the texts themselves.
    clear = out.join(several, last, "left_anti").drop(last)
    texts = docs.withColumn(last, classes(F.col("text"))[-1]).join(several, last, "left_semi")
    firsts = texts.groupBy("text").agg(F.min("doc_id").alias("first"))
    rest = texts.join(firsts, "text").select("doc_id", "part", (failures(F.col("text")) + copy).alias("mask"))
    return clear.unionByName(rest)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = masks(docs).join(marked, "doc_id", "left").groupBy("part", "mask")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.select("part", "masks", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.expr(f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)")
    earlier = F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (b, i) -> b + if(i < step, shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1), 0))")
    rows = rows.select("*", bit_of("substring(filter_order, step, 1)").alias("bit"), earlier.alias("before"))

    total = lambda test, what="m.n": F.expr(f"aggregate(masks, 0L, (s, m) -> s + if({test}, {what}, 0L))")
    here = "(m.mask & bit) != 0 AND (m.mask & before) = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("(m.mask & (before | bit)) = 0").alias("kept"),
        total(here).alias("removed"),
        total("(m.mask & bit) != 0 AND (m.mask & before) != 0").alias("redundant"),
        total("m.mask = bit").alias("unique_fails"),
        total(here, "m.good").alias("good_lost"),
        total(here, "m.toxic").alias("toxic_lost"),
        # Of the k filters that a document fails, each is the first of them in 120 / k orders.
        total("(m.mask & bit) != 0", "m.n * (120 div bit_count(m.mask))").alias("shapley"),
    )

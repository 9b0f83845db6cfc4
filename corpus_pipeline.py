"""From raw documents to token ids: quality, near copies, personal data, source weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again as the next stage's docs. All but the last return the columns of docs. Columns whose names an operator uses for
its own results are renamed while it works, and so are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm import bpe, common, mixing, ngram_join, pii, quality
from blockloom.llm.queries import vocabulary

ASIDE = "__aside_"
#: Words in a shingle and the least similarity, in percent, of near copies; op8's defaults bind that query alone.
COPY_WORDS, COPY_PERCENT = 5, 80


def guarded(docs: DataFrame, own: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) with docs' columns alone; those named like step's own results (any case) are put aside meanwhile."""
    clash = [c for c in docs.columns if c.lower() in own]
    out = step(docs.withColumnsRenamed({c: ASIDE + c for c in clash}))
    return out.select(*[F.col(ASIDE + c).alias(c) if c in clash else F.col(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold.

    Null, empty and very long texts are scored like others, from the whole text; repeated rows score alike, and so stay or
    go together; a score at the threshold stays; an empty table stays empty.
    """
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return guarded(docs, ("score", "predicted"), lambda d: quality.score(d, model).filter("predicted = 1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents: the one with the smallest id.

    Rows with a null id stay as they are. Of an id's repeated rows one stays, that with the smallest text. Null and empty
    texts are linked with nothing and stay; very long ones are compared whole; an empty table stays empty.
    """
    # Most ids stay as they are; the others, and ids of several rows, are fewer, so their texts alone are moved.
    found = ngram_join.link(docs, COPY_WORDS, COPY_PERCENT).filter("doc_id IS NOT NULL").groupBy("doc_id")
    found = found.agg(F.count(F.lit(1)).alias("__rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("__stays"))
    aside = common.saved(found.filter("NOT __stays OR __rows > 1"), "aside")
    again = aside.filter("__stays").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*docs.columns))
    again = common.among(docs, again, "doc_id").withColumn("__place", F.row_number().over(order)).filter("__place = 1")
    return common.not_among(docs, aside.select("doc_id"), "doc_id").unionByName(again.select(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the text.

    Null texts stay null and empty ones empty; texts and values of any length are read whole; repeated rows stay equal; an
    empty table stays empty.
    """
    out = guarded(docs, ("n_values", "kinds"), pii.pseudonymize)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; its copies are rows of the same id.

    A null source is a source of its own, the last; null and empty texts have no words and stay once, unless their source's
    target is 0; very long texts count all their words; repeated rows round alike; an empty table stays empty.
    """

    def step(d: DataFrame) -> DataFrame:
        mixed = mixing.mix(d, keep=[c for c in d.columns if c != "doc_id"])
        return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))

    return guarded(docs, ("size", "source_size", "target", "copies", "taken", "key", "u", "r", "up", "down", "up_to", "down_to", "lam", "mean", "__copy"), step)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text decoded from them.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows encode alike; an empty table
    gives an empty table.
    """
    encoded = bpe.encode(docs, vocabulary(), keep=["doc_id"])
    return bpe.digests(encoded, keep=["ids"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("PII pseudonyms", personal_data),
    ("source mix", source_mix),
    ("BPE", tokens),
]

#: A trained classifier and BPE are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

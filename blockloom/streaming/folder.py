"""A folder of word files as a stream: each new file is analysed whole in the micro-batch that brings it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocks, validate
from ..sources import docx
from ..sources.rules import Lexicon


def watch(spark: SparkSession, folder: str, rules: DataFrame, lex: Lexicon, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Analysed blocks, checks and unreadable files go to Parquet under out, by batch, so a rerun overwrites its own."""

    def step(batch: DataFrame, number: int) -> None:
        files = batch.persist()
        try:
            base = blocks.analysed(docx.block_rows(files).select("document_id", "block_order", "kind", "style", "text"), rules, lex)
            base.drop("rule_flags").write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
            validate.run_checks(base).write.mode("overwrite").parquet(f"{out}/checks/batch={number}")
            files.filter("error IS NOT NULL").select("path", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        finally:
            files.unpersist()

    writer = docx.read_docx(spark, folder, stream=True).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

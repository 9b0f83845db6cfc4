"""Sources as block rows: document_id, block_order, kind, style, text.

Every ordered source becomes the same table, so all operators work on pages, text lines, chats and word files alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of source files for each partition of blocks, and most partitions (sources that aren't files have no known size).
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 17
#: Marks within a text, which are left out; then tag and text of the elements of a page that carry blocks.
INLINE_PATTERN = r"</?(?:a|abbr|b|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|u)(?:\s[^>]*)?/?>"
PAGE_PATTERN = r"<(title|h1|li|p|footer|div)(?: [^>]*)?>([^<]*)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_document(blocks: DataFrame, source: DataFrame) -> DataFrame:
    """blocks dealt by document to as many partitions as the files of their source ask for, where the session has fewer.

    A task that sorts a partition holds it, so its memory would grow with the table if the number of partitions didn't.
    """
    files = source._jdf.queryExecution().analyzed().stats().sizeInBytes()
    wanted = -(-int(str(files)) // PART_BYTES)
    return blocks.repartition(wanted, "document_id") if int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")) < wanted <= MOST_PARTS else blocks


def page_blocks(pages: DataFrame) -> DataFrame:
    html = F.regexp_replace("html", INLINE_PATTERN, "")
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(PAGE_PATTERN), F.lit(1)).alias("style"), F.regexp_extract_all(html, F.lit(PAGE_PATTERN), F.lit(2)).alias("text"))
    out = pages.select(F.col("page_id").alias("document_id"), F.posexplode(found).alias("at", "b"))
    return out.select("document_id", (F.col("at") + 1).cast("long").alias("block_order"), F.lit("paragraph").alias("kind"), "b.style", "b.text")


def line_blocks(documents: DataFrame) -> DataFrame:
    """Lines of texts with styles by position: a fixture that exercises every operator on plain prose."""
    lines = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    k = ((F.col("document_id") * 7 + F.col("at")) % 16).cast("int")
    number = (F.floor(F.col("at") / 16) + 1).cast("string")
    head, line = F.substring("line", 1, 24), F.col("line")
    appendix = F.col("document_id") % 3 == 0
    cases = [
        ("Heading 1", F.concat(number, F.lit(" "), head)), ("Normal", line), ("Normal", F.concat(line, F.lit(":"))), ("List dash", F.concat(F.lit("- "), line)),
        ("List dash", F.concat(F.lit("- "), line, F.lit(";"))), ("Heading 2", F.concat(number, F.lit(".1 "), head)), ("Note label", F.lit("Note")), ("Note text", line),
        ("Table caption", F.concat(F.lit("Table "), number, F.lit(" "), head)), ("Normal", F.lit("")), (None, F.lit(None).cast("string")),
        ("Figure", F.concat(F.lit("Table "), number)), ("Body X", line), ("Heading X", head), ("For deletion", line),
        (F.when(appendix, "Heading 1").otherwise("Normal"), F.when(appendix, F.lit("Appendix A")).otherwise(line)),
    ]
    style = text = None
    for i, (s, t) in enumerate(cases):
        s = F.lit(s).cast("string") if s is None or isinstance(s, str) else s
        style, text = (F.when(k == i, s), F.when(k == i, t)) if style is None else (style.when(k == i, s), text.when(k == i, t))
    kind = F.when(k == 10, F.lit("table")).otherwise(F.lit("paragraph"))
    # Tables of a third of the documents have no payload, those of another third no number of columns.
    third, is_table = F.col("document_id") % 3, k == 10
    return lines.select(
        "document_id", (F.col("at") + 1).cast("long").alias("block_order"), kind.alias("kind"), style.alias("style"), text.alias("text"),
        F.when(is_table & (third != 0), F.lit(1)).cast("long").alias("table_rows"), F.when(is_table & (third == 1), F.lit(2)).cast("long").alias("table_cols"),
    )


def deep_blocks(documents: DataFrame) -> DataFrame:
    """Lines of texts under headings of fifteen levels, with title pages, control sheets and appendices between them."""
    lines = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    at, doc, line = F.col("at").cast("long"), F.col("document_id"), F.col("line")
    odd = F.when((at % 40 == 39) & (doc % 2 == 0), 11).when(at % 9 < 2, (doc * 7 + at * at + at * (doc % 5)) % 16)
    k = F.coalesce(odd, (doc + at) % 5).cast("int")
    part = F.concat(F.lit("Part "), at.cast("string"))
    others = [
        ("Title line", line), ("Title line", F.lit("Bibliography")), ("Cover", line), ("Structural, not in contents", F.lit("The control sheet")), ("Heading Title", part), ("Normal", F.lit("Contents")),
        ("Appendix head", F.lit("Appendix B")), ("Normal", F.lit("Bibliography")), (None, line), ("Meta", line), ("Normal", line),
    ]
    style, text = F.when(k < 5, F.concat(F.lit("Heading "), (1 + (at * 7 + doc) % 15).cast("string"))), F.when(k < 5, part)
    for i, (s, t) in enumerate(others, 5):
        style, text = style.when(k == i, F.lit(s).cast("string")), text.when(k == i, t)
    return lines.select("document_id", (at + 1).alias("block_order"), F.lit("paragraph").alias("kind"), style.alias("style"), text.alias("text"))


def chat_blocks(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("long").alias("block_order"), F.lit("paragraph").alias("kind"), F.col("role").alias("style"), "text"
    )


def order_cells(lineitem: DataFrame) -> DataFrame:
    """Order lines as table cells; equal values that adjoin in a column share a cell key, as merged cells do."""
    cells = F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = lineitem.select(F.col("l_orderkey").alias("document_id"), F.row_number().over(order).cast("long").alias("row"), cells.alias("cells"))
    grid = rows.select("document_id", "row", F.posexplode("cells").alias("col", "text"))
    return grid.withColumn("col", F.col("col").cast("long"))


def order_written_rows(lineitem: DataFrame) -> DataFrame:
    """Order lines as the rows of a written table: cells of one or two columns, each going on with the one above where
    texts agree; every third row has a cell less. One sort by order and line serves the rows' numbers and the texts above."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = lineitem.withColumn("row", F.row_number().over(order).cast("long"))
    number, even = F.col("row"), lambda c: (F.lit(1) + c % 2).cast("long")
    percent = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    texts = [F.col("l_returnflag"), F.col("l_linestatus"), F.when(number % 3 != 0, percent("l_discount")), percent("l_tax")]
    widths = [even(F.col("l_orderkey")), even(F.floor(number / 4)), F.lit(1).cast("long"), even(F.col("l_linenumber"))]
    cells = F.array(*[F.struct(x.alias("text"), w.alias("span")) for x, w in zip(texts, widths, strict=True)])
    rows = rows.withColumn("cells", F.filter(cells, lambda c: c["text"].isNotNull()))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.get("cells", F.lit(i))["text"], ignorenulls=True).over(before) for i in range(len(texts))]
    rows = rows.select(F.col("l_orderkey").alias("document_id"), "row", "cells", F.array(*above).alias("above"))
    merge = lambda c, i: F.when(F.get("above", i) == c["text"], "continue").when(i < 2, "restart")
    written = F.transform("cells", lambda c, i: F.struct(i.cast("long").alias("place"), c["text"].alias("text"), c["span"].alias("span"), merge(c, i).alias("merge")))
    return rows.select("document_id", "row", written.alias("cells"))


def order_written_cells(lineitem: DataFrame) -> DataFrame:
    """The cells of order_written_rows(), a row for each."""
    return order_written_rows(lineitem).select("document_id", "row", F.explode("cells").alias("c")).select("document_id", "row", "c.*")

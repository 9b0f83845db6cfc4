"""Rows of a review document, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .blocks import COUNTED, logical_notes

#: Counters of a document's summary.
COUNTERS = ["total_blocks", *COUNTED, "total_notes"]


def body_text(base: DataFrame) -> Column:
    """A block's text with its list prefix, a diagnostic label, or a table's size and cells."""
    kind, text = F.col("block_type"), F.col("norm")
    labelled = lambda label: F.concat(F.lit(label), F.when(text == "", "").otherwise(F.concat(F.lit(" "), text)))
    size = [F.coalesce(F.col(x), F.lit(0)) if x in base.columns else F.lit(0) for x in ("table_rows", "table_cols")]
    known = F.col("table_rows").isNotNull() | F.col("table_cols").isNotNull() if "table_rows" in base.columns else F.lit(False)
    name = F.col("table_id") if "table_id" in base.columns else F.lit("-")
    style = F.when(F.col("style") == "", "-").otherwise(F.col("style"))
    meta = F.format_string("table_id=%s | rows=%d | cols=%d | style=%s | header_row=%s", F.coalesce(name, F.lit("-")), *size, style, F.when(size[0] > 0, "True").otherwise("False"))
    cells = F.lit("")
    if "cells" in base.columns:  # rows of texts
        cells = F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("cells", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")), F.lit(""))
    table = F.when(~known, "[TABLE BLOCK WITHOUT TABLE_INFO]").when((size[0] == 0) | (size[1] == 0), F.concat(meta, F.lit("\n[EMPTY TABLE]"))).otherwise(F.concat(meta, cells))
    marker = F.col("list_mark") if "list_mark" in base.columns else F.lit(None).cast("string")
    depth = F.coalesce(*[F.col(x) for x in ("list_level", "rule_list_level") if x in base.columns], F.lit(0))
    prefix = F.when(kind == "list_item", F.concat(F.repeat(F.lit("  "), depth.cast("int")), F.coalesce(marker, F.lit("-")), F.lit(" "))).otherwise("")
    return (
        F.when(kind == "table", table).when(kind == "empty", labelled("[EMPTY BLOCK]")).when(kind == "unknown", labelled("[UNKNOWN BLOCK]"))
        .otherwise(F.concat(prefix, F.when(text == "", "[NO TEXT]").otherwise(text)))
    )


def render_rows(base: DataFrame) -> DataFrame:
    """A header line for each block, its review hints, and its text or a placeholder."""
    path = F.coalesce(F.array_join("section_path", " > "), F.lit(""))
    header = F.format_string(
        "[BLOCK %04d] id=%s | type=%s | zone=%s | section=%s | style=%s", F.col("block_order"), F.col("block_id"), F.col("block_type"), F.col("zone"),
        F.when(path == "", "-").otherwise(path), F.when(F.col("style") == "", "-").otherwise(F.col("style")),
    )
    orphan, review = F.coalesce("is_orphan", F.lit(False)), F.array_contains("flags", "needs_review")
    marks = [
        (review, "needs_review"), (F.array_contains("flags", "is_suspicious"), "suspicious"), (orphan | review, "unresolved"),
        (F.array_contains("flags", "is_empty") & (F.col("block_type") != "empty"), "flag:is_empty"),
    ]
    hints = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in marks]))
    hint = F.when(F.size(hints) > 0, F.concat(F.lit("[REVIEW] "), F.array_join(hints, " | ")))
    body = body_text(base)
    show = F.col("block_type") != "empty"
    return base.select("document_id", "block_order", header.alias("header"), hint.alias("hint"), body.alias("body"), show.alias("show"), (orphan | review).alias("unresolved"))


FIELDS = ["block_id", "block_order", "zone", "block_type", "block_subtype", "norm", "section_path", "flags", "prev_id", "next_id", "note_group", "reasons"]
#: Fields that are written and read where the blocks have them.
MORE = {
    "style": "string", "is_orphan": "boolean", "section_id": "string", "section_title": "string", "heading_number": "string", "heading_level": "int", "list_type": "string", "list_mark": "string",
    "rule_list_level": "int", "note_role": "string", "list_follows": "boolean", "table_id": "string", "table_rows": "long", "table_cols": "long", "cells": "array<array<string>>",
}


def _block_list(base: DataFrame) -> Column:
    listed = F.array_sort(F.collect_list(F.struct("block_order", F.struct(*FIELDS, *[c for c in MORE if c in base.columns]).alias("b"))))
    return F.transform(listed, lambda x: x["b"])


def _as_json(rows: DataFrame, fields: list[str], nulls: bool) -> DataFrame:
    return rows.select("document_id", F.to_json(F.struct("document_id", *fields), {"ignoreNullFields": str(not nulls).lower()}).alias("json"))


def document_json(base: DataFrame, nulls: bool = False) -> DataFrame:
    """One JSON text per document; nulls are left out unless asked for."""
    return _as_json(base.groupBy("document_id").agg(_block_list(base).alias("blocks")), ["blocks"], nulls)


def whole_document_json(base: DataFrame, template: str | None = None, nulls: bool = False) -> DataFrame:
    """One JSON text per document with its source, summary, used styles and blocks.

    Blocks lie together by document after their analysis, so the parts are made in one aggregation without an exchange.
    """
    counts = {"total_blocks": F.count(F.lit(1)), **{n: F.count_if(F.col("block_type") == kind) for n, kind in COUNTED.items()}, "total_notes": logical_notes()}
    styles = F.array_sort(F.collect_set(t.null_if_empty(t.strip(F.coalesce("style", F.lit(""))))))
    out = base.groupBy("document_id").agg(*[c.alias(n) for n, c in counts.items()], styles.alias("styles"), _block_list(base).alias("blocks"))
    source = F.struct(F.col("document_id").cast("string").alias("path"), F.lit(template).cast("string").alias("template_id"))
    return _as_json(out.withColumns({"source": source, "summary": F.struct(*COUNTERS)}), ["source", "summary", "styles", "blocks"], nulls)


def read_document_parts(frame: DataFrame, id_type: str = "long") -> DataFrame:
    """document_id, path, template_id, the summary's counters and styles of whole_document_json()'s texts."""
    counters = ",".join(f"{c}:long" for c in COUNTERS)
    schema = f"document_id {id_type}, source struct<path:string,template_id:string>, summary struct<{counters}>, styles array<string>"
    parsed = frame.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("d"))
    counted = [F.coalesce(F.col(f"d.summary.{c}"), F.lit(0).cast("long")).alias(c) for c in COUNTERS]
    return parsed.select("d.document_id", "d.source.*", *counted, F.coalesce("d.styles", F.array().cast("array<string>")).alias("styles"))


def read_document_json(frame: DataFrame, id_type: str = "long") -> DataFrame:
    """Block rows back from document_json()'s texts.

    Missing texts, lists and types get their defaults, other missing fields are null; a text that isn't JSON is an error.
    """
    lists = ("section_path", "flags", "reasons")
    kinds = {**{f: "array<string>" if f in lists else "long" if f == "block_order" else "string" for f in FIELDS}, **MORE}
    schema = f"document_id {id_type}, blocks array<struct<{','.join(f'{f}:{k}' for f, k in kinds.items())}>>"
    parsed = frame.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("d"))
    rows = parsed.select("d.document_id", F.explode("d.blocks").alias("b")).select("document_id", "b.*")
    plain = {"zone": "unknown_zone", "block_type": "unknown", "norm": "", "style": ""}
    none = F.array().cast("array<string>")
    return rows.withColumns({**{f: F.coalesce(f, F.lit(x)) for f, x in plain.items()}, **{f: F.coalesce(f, none) for f in lists}})


def text_lines(base: DataFrame) -> DataFrame:
    """The review document as ordered lines of text."""
    rows = render_rows(base)
    lines = F.posexplode(F.array_compact(F.array("header", "hint", "body")))
    out = rows.select("document_id", "block_order", lines.alias("at", "line"))
    return out.withColumn("line_no", F.row_number().over(Window.partitionBy("document_id").orderBy("block_order", "at")).cast("long")).select("document_id", "line_no", "line")

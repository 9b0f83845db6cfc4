"""Word files as block rows, with the standard library alone.

Files are read by Spark (binaryFile), so any store works; a task decodes one archive at a time, and a broken file gives
a row with its error instead of failing the job. From the decoded rows everything else is DataFrame operations.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import tables

# Fixed values of the file format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "distribute"}
DISPLAY_NAMES = {"caption": "Caption", "header": "Header", "footer": "Footer", **{f"heading {i}": f"Heading {i}" for i in range(1, 10)}}
UNDERLINE_OFF = {"none"}

PARAGRAPH = "struct<alignment:string,left_pt:double,right_pt:double,first_line_pt:double,before_pt:double,after_pt:double,line_spacing:double,keep_next:boolean,keep_lines:boolean,page_break:boolean>"
RUN = "struct<text:string,char_style:string,bold:boolean,italic:boolean,underline:boolean,font:string,size_pt:double,color:string,highlight:string>"
BLOCK = f"struct<block_order:long,kind:string,style:string,text:string,paragraph_index:long,table_index:long,bold:boolean,italic:boolean,underline:boolean,left_indent:int,first_line_indent:int,paragraph:{PARAGRAPH},runs:array<{RUN}>>"
CELL = "struct<table_index:long,row:long,place:long,span:long,merge:string,text:string,style:string,alignment:string,vertical:string,table_style:string>"
STYLE = f"struct<style_name:string,style_type:string,base_style:string,paragraph:{PARAGRAPH},run:{RUN}>"
SCHEMA = f"path string, error string, blocks array<{BLOCK}>, cells array<{CELL}>, styles array<{STYLE}>"


def child(node, *names: str):
    for name in names:
        node = node.find(W + name) if node is not None else None
    return node


def value(node, name: str = "val") -> str | None:
    return node.get(W + name) if node is not None else None


def switch(node) -> bool | None:
    """A tri-state property: absent is null."""
    return None if node is None else value(node) not in ("0", "false", "off")


def points(raw: str | None) -> float | None:
    """Twentieths of a point."""
    try:
        return None if raw is None else round(float(raw) / 20, 2)
    except ValueError:
        return None


def paragraph_format(props) -> dict:
    indent, spacing = child(props, "ind"), child(props, "spacing")
    first, hanging = points(value(indent, "firstLine")), points(value(indent, "hanging"))
    line, rule = value(spacing, "line"), value(spacing, "lineRule") or "auto"
    left, right = value(indent, "left") or value(indent, "start"), value(indent, "right") or value(indent, "end")
    return {
        "alignment": ALIGNMENTS.get(value(child(props, "jc")) or "", None), "left_pt": points(left), "right_pt": points(right),
        "first_line_pt": -hanging if hanging is not None else first, "before_pt": points(value(spacing, "before")), "after_pt": points(value(spacing, "after")),
        "line_spacing": float(line) / 240 if line and rule == "auto" else None, "keep_next": switch(child(props, "keepNext")),
        "keep_lines": switch(child(props, "keepLines")), "page_break": switch(child(props, "pageBreakBefore")),
    }


def run_format(props, text: str, style: str | None) -> dict:
    under, fonts, size = child(props, "u"), child(props, "rFonts"), value(child(props, "sz"))
    color, shade = value(child(props, "color")), value(child(props, "highlight"))
    return {
        "text": text, "char_style": style, "bold": switch(child(props, "b")), "italic": switch(child(props, "i")),
        "underline": None if under is None else value(under) not in UNDERLINE_OFF, "font": value(fonts, "ascii"), "size_pt": float(size) / 2 if size else None,
        "color": color if color and color != "auto" else None, "highlight": shade.lower() if shade and shade != "none" else None,
    }


def run_text(run) -> str:
    out = []
    for x in run:
        tag = x.tag.removeprefix(W)
        out.append((x.text or "") if tag == "t" else {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(tag, ""))
    return "".join(out)


def own_runs(paragraph) -> list:
    return [x for x in paragraph if x.tag == W + "r"]


def paragraph_text(paragraph) -> str:
    return "".join(run_text(r) for x in paragraph for r in ([x] if x.tag == W + "r" else x.findall(W + "r") if x.tag == W + "hyperlink" else []))


class Styles:
    def __init__(self, root) -> None:
        self.nodes = {} if root is None else {s.get(W + "styleId"): s for s in root.findall(W + "style")}
        self.default = {s.get(W + "type"): k for k, s in self.nodes.items() if s.get(W + "default") in ("1", "true")}

    def name(self, key: str | None, kind: str) -> str | None:
        node = self.nodes.get(key) if key in self.nodes else self.nodes.get(self.default.get(kind))
        raw = value(child(node, "name")) if node is not None else None
        return DISPLAY_NAMES.get(raw, raw) if raw else None

    def rows(self) -> Iterator[dict]:
        for node in self.nodes.values():
            raw = value(child(node, "name"))
            name, base = DISPLAY_NAMES.get(raw, raw), value(child(node, "basedOn"))
            yield {
                "style_name": name, "style_type": {"numbering": "list"}.get(node.get(W + "type"), node.get(W + "type")), "base_style": self.name(base, "") if base in self.nodes else None,
                "paragraph": paragraph_format(child(node, "pPr")), "run": run_format(child(node, "rPr"), "", name),
            }


def decode(data: bytes) -> dict:
    """Blocks, table cells and styles of one file."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = child(ET.fromstring(archive.read("word/document.xml")), "body")
        styles = Styles(ET.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else None)
    blocks, cells, paragraphs, tables = [], [], 0, 0
    for node in body if body is not None else []:
        if node.tag == W + "p":
            paragraphs += 1
            props, runs = child(node, "pPr"), own_runs(node)
            look = paragraph_format(props)
            formats = [run_format(child(r, "rPr"), run_text(r), styles.name(value(child(r, "rPr", "rStyle")), "character")) for r in runs]
            first = formats[0] if formats else {}
            blocks.append({
                "block_order": len(blocks) + 1, "kind": "paragraph", "style": styles.name(value(child(props, "pStyle")), "paragraph"), "text": paragraph_text(node),
                "paragraph_index": paragraphs, "table_index": None, **{k: bool(first.get(k)) for k in ("bold", "italic", "underline")},
                # Zero indents count as none here; the formatting keeps them.
                "left_indent": int(look["left_pt"] * 20) if look["left_pt"] else None, "first_line_indent": int(look["first_line_pt"] * 20) if look["first_line_pt"] else None,
                "paragraph": look, "runs": formats,
            })
        elif node.tag == W + "tbl":
            tables += 1
            blocks.append({"block_order": len(blocks) + 1, "kind": "table", "style": None, "text": None, "paragraph_index": None, "table_index": tables, "bold": False, "italic": False, "underline": False, "left_indent": None, "first_line_indent": None, "paragraph": None, "runs": None})
            cells += table_cells(node, tables, styles)
    return {"error": None, "blocks": blocks, "cells": cells, "styles": list(styles.rows())}


def table_cells(table, index: int, styles: Styles) -> Iterator[dict]:
    """A row per cell as it is written: its place in the row, its span and whether it goes on with the one above."""
    look = styles.name(value(child(table, "tblPr", "tblStyle")), "table")
    for r, row in enumerate(table.findall(W + "tr")):
        for place, cell in enumerate(row.findall(W + "tc")):
            props = child(cell, "tcPr")
            merge, paragraphs = child(props, "vMerge"), cell.findall(W + "p")
            first = child(paragraphs[0], "pPr") if paragraphs else None
            yield {
                "table_index": index, "row": r, "place": place, "span": int(value(child(props, "gridSpan")) or 1), "merge": None if merge is None else value(merge) or "continue",
                "text": "\n".join(map(paragraph_text, paragraphs)), "style": styles.name(value(child(first, "pStyle")), "paragraph") if paragraphs else None,
                "alignment": ALIGNMENTS.get(value(child(first, "jc")) or "", None), "vertical": value(child(props, "vAlign")), "table_style": look,
            }


def read_docx(spark: SparkSession, path: str | list[str], stream: bool = False) -> DataFrame:
    """One row per file: path, error, blocks, cells, styles; files in folders below a folder are read, too."""
    import pandas as pd

    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = decode(data)
                except Exception as problem:  # noqa: BLE001  one bad file must not end the job
                    out = {"error": f"{type(problem).__name__}: {problem}", "blocks": [], "cells": [], "styles": []}
                yield pd.DataFrame([{"path": name, **out}])

    return files.mapInPandas(run, SCHEMA)


def block_rows(files: DataFrame) -> DataFrame:
    """The input of the engine, with the file's own columns besides."""
    return files.select(F.col("path").alias("document_id"), F.explode("blocks").alias("b")).select("document_id", "b.*")


def cell_rows(files: DataFrame) -> DataFrame:
    """Grid positions of all tables, with the look of the cells that they belong to."""
    rows = files.select(F.col("path").alias("document"), F.explode("cells").alias("c")).select("document", "c.*")
    rows = rows.withColumn("document_id", F.concat_ws("#", "document", F.format_string("tbl_%04d", F.col("table_index"))))
    return tables.layout(rows, ["document", "table_index", "style", "alignment", "vertical", "table_style"])


def style_catalog(files: DataFrame) -> DataFrame:
    """Styles with their defaults; defaults without any value are null."""
    rows = files.select(F.col("path").alias("document_id"), F.explode("styles").alias("s")).select("document_id", "s.*")
    any_of = lambda name, fields: F.coalesce(*[F.col(name)[x].cast("string") for x in fields])
    look = ["alignment", "left_pt", "right_pt", "first_line_pt", "before_pt", "after_pt", "line_spacing", "keep_next", "keep_lines", "page_break"]
    font = ["font", "size_pt", "bold", "italic", "underline", "color", "highlight"]
    return rows.withColumns({"paragraph": F.when(any_of("paragraph", look).isNotNull(), F.col("paragraph")), "run": F.when(any_of("run", font).isNotNull(), F.col("run"))})


def list_formatting(kind: Column, list_type: Column, mark: Column, raw: Column, block_id: Column, level: Column) -> Column:
    """List look of a list item: marker found, marker visible, or the type's usual one."""
    visible = t.group(raw, r"^\s*([-•–]|[0-9]+[.)]|[A-Za-zА-Яа-я]\))")
    usual = F.when(list_type == "bulleted", "-").when(list_type == "numbered", "1.").when(list_type == "lettered", "a)")
    style = F.when(list_type == "bulleted", "bullet").otherwise(list_type)
    return F.when(kind == "list_item", F.struct(block_id.alias("list_id"), level.alias("level"), list_type.alias("marker_type"), F.coalesce(mark, visible, usual).alias("marker_text"), style.alias("numbering_style")))

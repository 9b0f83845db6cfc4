"""Sinks: JSON documents and reports, and review documents as word files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import render

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def write_documents(base: DataFrame, path: str) -> None:
    """One JSON text per document and line, without nulls."""
    render.document_json(base).select("json").write.text(path)


def write_whole_documents(base: DataFrame, path: str, template: str | None = None) -> None:
    """One JSON text per document and line, with source, summary, styles and blocks."""
    render.whole_document_json(base, template).select("json").write.text(path)


def payload(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Derived rows of each document as one JSON text: its id, their number, and the rows in order under their name."""
    fields = [c for c in rows.columns if c != "document_id"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("row")))), lambda x: x["row"])
    out = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias(f"total_{name}"), listed.alias(name))
    return out.select("document_id", F.to_json(F.struct("document_id", f"total_{name}", name)).alias("json"))


def write_rows(rows: DataFrame, path: str, nulls: bool = True) -> None:
    """Derived rows (candidates, records, decisions, questions) as JSON lines; nulls are kept unless told otherwise."""
    rows.write.option("ignoreNullFields", str(not nulls).lower()).json(path)


def write_reports(checks: DataFrame, path: str) -> None:
    """A folder of reports per document."""
    checks.repartition("document_id").write.partitionBy("document_id").json(path)


def exit_code(summary: DataFrame) -> int:
    """1 if any document failed."""
    return int(summary.select(F.max("failed_documents")).first()[0] > 0)


def review_files(base: DataFrame) -> DataFrame:
    """document_id and content: a word file for each document, from its rendered lines."""
    lines = render.text_lines(base).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["content"] = [word_file(list(x)) for x in batch["lines"]]
            yield batch[["document_id", "content"]]

    kind = base.schema["document_id"].dataType.simpleString()
    return lines.mapInPandas(run, f"document_id {kind}, content binary")


def word_file(lines: list[str]) -> bytes:
    text = lambda line: '<w:br/>'.join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in line.split("\n"))
    body = "".join(f"<w:p><w:r>{text(line)}</w:r></w:p>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", TYPES)
        archive.writestr("_rels/.rels", RELS)
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {SPACE}><w:body>{body}</w:body></w:document>')
    return out.getvalue()

"""Web archives: legacy ARC files in, WARC 1.0 files out, and readers for both.

The converter parses an ARC file's version block, whose last lines say which header fields each record has (version 1:
URL, IP, date, type, length; version 2 adds result code, checksum, location, offset and file name), then walks the
records by their declared lengths. For each it synthesises a WARC identifier, timestamp, type and digests.

Files are written by Spark's text sink: a row is one record, and the line separator is the separator that the format
asks for between records. Each file holds FILE_ROWS records and starts with the format's own first record, so files are
bounded, and a lost task is simply run again. Files are gzip streams, and readers take plain files too. Readers take
whole files, which FILE_ROWS keeps small.

Cases: a null html is an empty payload; a null url is written as '-'; a null page id is left out and read back as null;
white space in a url is percent-encoded; rows that repeat the smallest page id of a payload are all responses; payloads
may hold anything, record separators included; an empty table gives no files and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records in one file; the smallest payload in bytes that a revisit may stand for.
FILE_ROWS, LEAST_REVISIT = 2048, 100
#: Fixed values of the formats.
ARC_DATE, WARC_DATE = "20240101000000", "2024-01-01T00:00:00Z"
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_SCHEMA = "url string, ip string, date string, mime string, page_id long, http string, payload string, payload_bytes long, digest string"
WARC_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def arc_block(version: str) -> str:
    """The version block that starts an ARC file."""
    reserved = {"1": "1 0", "2": "2 0"}[version]
    body = f"{reserved} blockloom\n{ARC_FIELDS[version]}\n"
    head = f"filedesc://part.arc 0.0.0.0 {ARC_DATE} text/plain"
    return f"{head} {len(body)}\n{body}" if version == "1" else f"{head} 200 - - 0 part.arc {len(body)}\n{body}"


def arc_record(version: str, url: str | None, page_id: int | None, html: str) -> str:
    name = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    length = len(head) + len(html.encode())
    fields = f"{name} 0.0.0.0 {ARC_DATE} text/html"
    return f"{fields} {length}\n{head}{html}" if version == "1" else f"{fields} 200 - - 0 part.arc {length}\n{head}{html}"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file of either version."""
    end = data.index(b"\n")
    at = end + 1 + int(data[:end].split(b" ")[-1])
    names = data[end + 1 : at].rstrip(b"\n").split(b"\n")[1].decode().split(" ")
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        fields = dict(zip(names, data[at:end].decode().split(" "), strict=True))
        start = end + 1
        at = start + int(fields["Archive-length"])
        body = data[start:at]
        head, _, payload = body.partition(b"\r\n\r\n")
        page = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
        yield {
            "url": fields["URL"], "ip": fields["IP-address"], "date": fields["Archive-date"], "mime": fields["Content-type"],
            "page_id": int(page[1]) if page else None, "http": head.decode(), "payload": payload.decode(),
            "payload_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest(),
        }


def record_id(*parts: object) -> str:
    """An identifier that reruns repeat."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_date(arc_date: str) -> str:
    """A 14-digit ARC date, or a shorter one, as a WARC timestamp."""
    digits = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else ARC_DATE
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def warc_info(part: str = "") -> str:
    """The record that starts a file; part names the file."""
    body = "software: blockloom\r\nformat: WARC File Format 1.0\r\n"
    return "WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id("warcinfo", part) + f"\r\nWARC-Date: {WARC_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}"


def warc_record(r: dict) -> str:
    """A response record, or a revisit record without payload where r['first'] is another page."""
    revisit = r["first"] is not None and r["first"] != r["page_id"]
    block = r["http"] + "\r\n\r\n" + ("" if revisit else r["payload"])
    raw = block.encode()
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {r['url']}", f"WARC-Date: {warc_date(r['date'])}",
        f"WARC-Record-ID: {record_id('record', r['page_id'], r['url'], r['digest'])}", f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha256:{r['digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(raw).hexdigest()}", f"X-Payload-Length: {r['payload_bytes']}",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id('record', r['first'], r['first_url'], r['digest'])}",
            f"WARC-Refers-To-Target-URI: {r['first_url']}", f"WARC-Refers-To-Date: {warc_date(r['first_date'])}", f"X-Refers-To-Page: {r['first']}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record of one WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        yield head, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {at}")
        at += 4


def write_rows(df: DataFrame, first, line, separator: str, path: str) -> None:
    """Write line(row) for each row of df; first(name) starts each file."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches: Iterator) -> Iterator:
        n, task = 0, TaskContext.get().partitionId()
        for batch in common.pieces(batches):
            out = []
            for row in batch.to_pylist():
                if n % FILE_ROWS == 0:
                    out.append(first(f"{task}-{n // FILE_ROWS}"))
                n += 1
                out.append(line(row))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    common.small_batches(df.sparkSession)
    df.mapInArrow(run, "value string").write.option("lineSep", separator).option("maxRecordsPerFile", FILE_ROWS + 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that parse(bytes) makes of each file under path."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for content in batch.column(0):
                rows, data = [], content.as_py()
                for row in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return files.mapInArrow(run, schema)


def write_arc(pages: DataFrame, path: str, version: str = "1") -> None:
    """Write pages (page_id, url, html) as ARC files."""
    df = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    write_rows(df, lambda _: arc_block(version), lambda r: arc_record(version, r["url"], r["page_id"], r["html"]), "\n", path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_arc, ARC_SCHEMA)


def write_warc(records: DataFrame, path: str) -> None:
    """Write read_arc()'s records as WARC files; equal payloads of LEAST_REVISIT bytes or more become revisits."""
    # Only payloads that repeat are joined: a digest and an id each. The optimizer broadcasts them if their size allows.
    firsts = records.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url", "date")).alias("x"), F.count(F.lit(1)).alias("n"))
    named = firsts.filter("n > 1").select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"), F.col("x.date").alias("first_date"))
    write_rows(records.join(common.saved(named, "firsts"), "digest", "left"), warc_info, warc_record, "\r\n\r\n", path)


def warc_summary(data: bytes) -> Iterator[dict]:
    for head, block in parse_warc(data):
        if head["warc-type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        page, first = re.search(rb"\r\nX-Page-Id: (-?\d+)", http), head.get("x-refers-to-page")
        if head["warc-type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
        yield {"page_id": int(page[1]) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": int(first) if first else None}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record but warcinfo."""
    return read_files(spark, path, warc_summary, WARC_SCHEMA)


def convert(pages: DataFrame, version: str = "1") -> DataFrame:
    """Pages through ARC files, the converter and WARC files; returns what the WARC reader finds."""
    spark = pages.sparkSession
    if pages.limit(1).count() == 0:
        return spark.createDataFrame([], WARC_SCHEMA)
    arc, warc = common.scratch(spark, "arc"), common.scratch(spark, "warc")
    write_arc(pages, arc, version)
    write_warc(read_arc(spark, arc), warc)
    common.remove(spark, arc)
    return read_warc(spark, warc)

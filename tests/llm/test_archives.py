import hashlib

import pytest

from blockloom.llm import archives


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    tricky = "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n\nfiledesc://x 1 2 3 4\n" * 5
    rows = [(5, "http://a/ b", big, "k"), (3, "http://b", big, "k"), (7, None, big, "k"), (1, "u", None, None), (2, "u", "short", None), (4, "u", "short", None), (8, "é", tricky, None), (9, "", tricky, None), (None, "n", "z" * 150, None), (10, "u", "ü" * 50, None), (11, "u", "ü" * 50, None), (3, "http://b", big, "k"), (12, "v", "y" * 300_000, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("version", ["1", "2"])
def test_round_trip(pages, version, monkeypatch):
    monkeypatch.setattr(archives, "FILE_ROWS", 3)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for page, raw in rows:
        if len(raw) >= 100 and page is not None:
            first[raw] = min(page, first.get(raw, page))
    want = []
    for page, raw in rows:
        to = first.get(raw)
        revisit = to is not None and to != page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, archives.convert(pages, version).collect()), key=key) == sorted(want, key=key)


def test_arc_fields():
    for version in "12":
        data = (archives.arc_block(version) + "\n" + archives.arc_record(version, "http://a b", 4, "ü\n\n") + "\n" + archives.arc_record(version, None, None, "") + "\n").encode()
        one, two = archives.parse_arc(data)
        assert (one["url"], one["page_id"], one["payload"], one["payload_bytes"], one["mime"]) == ("http://a%20b", 4, "ü\n\n", 4, "text/html")
        assert (two["url"], two["page_id"], two["payload"]) == ("-", None, "")


def test_warc_identifiers_repeat():
    row = {"url": "u", "ip": "0", "date": "2001", "page_id": 1, "http": "HTTP/1.1 200 OK", "payload": "x", "payload_bytes": 1, "digest": "d", "first": None}
    (head, block), = archives.parse_warc((archives.warc_record(row) + "\r\n\r\n").encode())
    assert archives.warc_record(row) == archives.warc_record(row) and head["warc-date"] == "2001-01-01T00:00:00Z" and block.endswith(b"\r\n\r\nx")


def test_empty(spark, pages):
    assert archives.convert(pages.limit(0)).count() == 0

import hashlib
import re
from collections import defaultdict

from blockloom.llm import secret_scan

LIVE = "Zx9Kq2Lm7Pw4Rt6Yb1Nc"
COPIED = "AbCdEf0123456789GhIjKl"


def plain_base(text):
    """The contract, word for word."""
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end(), m.group(2)))
    for place, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), place, m.end(), m.group()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return sorted(out)


def plain(rows):
    """doc_id, base digest and spans of each row, with counts over all rows."""
    per_row, docs, owners = [], defaultdict(set), defaultdict(set)
    for doc_id, text, source in rows:
        text = text or ""
        spans = plain_base(text)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            v = m.group()
            if len(v) >= 20 and len(set(v)) >= 10 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not any(s < m.end() and m.start() < e for s, p, e, _ in spans if p < 3):
                spans.append((m.start(), 3, m.end(), v))
        per_row.append((doc_id, sorted(spans)))
        for *_, v in spans:
            docs[v].add(doc_id)
            owners[v].add(source)
    out = []
    for doc_id, spans in per_row:
        kept = [(s, p, e) for s, p, e, v in spans if p < 3 or len(owners[v]) < 3]
        said = lambda some: ",".join(f"{secret_scan.KINDS[p]}:{s}:{e}" for s, p, e in some)
        base = [x for x in kept if x[1] < 3]
        out.append((doc_id, *[sum(p == k for _, p, _ in base) for k in range(3)], hashlib.sha256(said(base).encode()).hexdigest(), said(kept)))
    return sorted(out, key=str)


TEXTS = [
    None, "", "no secret here", "password: secret = abcdefghijklmnop", 'API_KEY="abcdefghijkl" apikey:short', "AKIAABCDEFGHIJKLMN AKIAAKIASHORT", "0123456789abcdef 0123456789abcde",
    "token=" + "0123456789abcdef" * 3, "ſecret = abcdefghijklmnop toKen : 'abcdefghijkl.", "é" * 7 + " " + LIVE + " ünï " + LIVE, "x " + COPIED, "passwd=token=abcdefghijkl", "word " * 50_000 + "secret='" + LIVE + "'",
    "a" * 300_000, "password =    \t nothing", "PASSWORD:abcdef\nabcdefabcdef",
]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS value", "1 AS row_id", "'k' AS kind", "0 AS owner")
    out = secret_scan.digests(secret_scan.find(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_a_plain_version(spark):
    rows = [(i, t, None if i % 5 == 4 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[9], (None, TEXTS[4], "s1"), (None, None, None)]
    rows += [(100 + i, "see " + COPIED, f"owner{i % 4}") for i in range(12)]
    assert run(spark, rows) == plain(rows)


def test_copied_values_are_examples_and_others_live(spark):
    rows = [(i, f"key {COPIED} {LIVE if i == 3 else ''} password={COPIED}", f"o{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.spans for r in secret_scan.find(docs).collect()}
    assert all(s.verdict == "example" and s.kind == "assign" for i in (0, 1, 2, 4) for s in found[i])
    assert [(s.kind, s.verdict, s.repositories, s.owners) for s in found[3]] == [("live", "live", 1, 1), ("assign", "example", 5, 5)]


def test_no_rows(spark):
    assert run(spark, []) == []

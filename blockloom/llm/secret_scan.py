"""Secrets in texts, and how widely each value is copied over the corpus.

1. Each whole text is scanned once. Base spans are assignments (`password = ...`), access keys and hex runs; candidates
   besides them are long words of the alphabet of keys that look live: letters and digits, DISTINCT characters or more.
2. The hashes of all values, base ones too, are aggregated over the corpus: in how many repositories (documents) and with
   how many owners (sources; null is one of its own) each occurs. A repository counts once however often it repeats.
3. A value with EXAMPLE_OWNERS owners or more is a copied example. Other values that look live are owner-specific; those
   of candidates become spans of kind `live`. Base spans always stay, whatever their value is.

Only hashes are shuffled, never texts. Counts are taken per (value, owner) before per value, so a value that a third of
all documents hold is summed up where it is read; the join that brings counts back is one that Spark splits when skewed.

Cases: a null text is empty and has no spans; every row gives a row, repeated rows and those with null ids too (rows with
a null id count as one repository); very long texts are scanned whole; values that overlap a base span are no
candidates; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed by the contract: keys, values and least lengths of base spans, in the order of kinds that start together.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Candidates: words of the alphabet of keys, their least length and number of distinct characters.
WORD = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST_WORD, DISTINCT = 20, 10
#: A value of so many owners is an example that was copied.
EXAMPLE_OWNERS = 3

SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("looks_live", T.BooleanType()), T.StructField("value", T.BinaryType())]
)


def _marks(pattern: str) -> bytes:
    """A table that turns bytes of the class into 1 and all others into 0."""
    return bytes(49 if re.fullmatch(pattern, chr(b)) and b < 128 else 48 for b in range(256))


_HEX_MARKS, _WORD_MARKS = _marks("[0-9a-f]"), _marks("[A-Za-z0-9+/_=-]")


def looks_live(value: str) -> bool:
    return len(set(value)) >= DISTINCT and any("0" <= c <= "9" for c in value) and any("A" <= c <= "Z" or "a" <= c <= "z" for c in value)


def scan(text: str) -> list[tuple[int, int, int, bool, bytes]]:
    """(start, place of the kind, end, looks live, hash of the value) of base spans and candidates, in code points.

    A text without a long enough run, or without a keyword, is not searched for that kind.
    """
    raw = text.encode("utf-8", "replace")
    low = raw.lower()
    found = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"api_key", b"apikey")):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"1" * LEAST_HEX in raw.translate(_HEX_MARKS):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    if b"1" * LEAST_WORD in raw.translate(_WORD_MARKS):
        taken = sorted((start, end) for start, _, end, _ in found)
        at, reach = 0, 0
        for m in WORD.finditer(text):
            if len(m[0]) < LEAST_WORD:
                continue
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= m.start() and looks_live(m[0]):
                found.append((m.start(), 3, m.end(), m[0]))
    return [(start, place, end, looks_live(value), hashlib.sha256(value.encode("utf-8", "replace")).digest()[:16]) for start, place, end, value in sorted(found)]


def candidates(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, owner and found (an array of spans) of each row, written once; row_id tells equal rows apart."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(SPAN))
    names = [f.name for f in SPAN]
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", common.source_key(F.col("source")).alias("owner"), "text")
    found = common.map_batches(
        rows, lambda batch: [pa.array([[dict(zip(names, s, strict=True)) for s in scan(t)] for t in common.text_of(batch, "text")], kind)], [T.StructField("found", T.ArrayType(SPAN))], keep=["row_id", "doc_id", "owner"]
    )
    return common.saved(found, "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories and owners of each hashed value."""
    seen = found.select("doc_id", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value")).distinct()
    by_owner = seen.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def find(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id and spans of each row: an array of (start, kind, end, verdict, repositories, owners) in order.

    verdict: `example` for copied values, `live` for owner-specific ones that look live, else `weak`. Candidates that are
    not live are left out.
    """
    found = candidates(docs)
    hits = found.filter(F.size("found") > 0)
    each = hits.select("row_id", "doc_id", F.explode("found").alias("s")).select("row_id", "doc_id", "s.*")
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("looks_live"), "live").otherwise("weak")
    judged = each.join(ownership(hits), "value").withColumn("verdict", verdict)
    kept = F.when((F.col("place") < 3) | (F.col("verdict") == "live"), F.struct("start", "place", "end", "verdict", "repositories", "owners"))
    some = judged.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(kept)).alias("spans"))
    none = found.filter(F.size("found") == 0).select("row_id", "doc_id", F.lit(None).cast(some.schema["spans"].dataType).alias("spans"))
    out = some.unionByName(none)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    name = lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["place"] + 1).alias("kind"), *[s[c].alias(c) for c in ("end", "verdict", "repositories", "owners")])
    return out.select("doc_id", F.coalesce(F.transform("spans", name), F.array()).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind and verdict, the digest of base spans and the list of all spans."""
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "live")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("verdict", "example").alias("n_examples"),
        count("verdict", "live").alias("n_owner_specific"),
    )

"""BPE encoding and decoding with a public vocabulary.

Each word is merged with a priority queue of merge ranks over a doubly linked list of symbols. Queue entries whose
pair has changed since they were pushed are stale and are skipped, so a word of n symbols takes O(n log n) steps,
however long it is. Decoding concatenates vocabulary strings.

Cases: a null or empty text has no tokens and decodes to ''; repeated rows and ties are encoded row by row; columns of
the input named like an output column are replaced; an empty table gives an empty table with the same schema.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words kept in a worker's cache, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 40
#: Bits of a token id, and of a place in a word.
ID, PLACE = 20, 40
#: White space as the normalizer's pattern engine defines it.
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    for b in range(256):
        symbols.setdefault(b, chr(256 + len(symbols) - len(plain)))
    return [symbols[b] for b in range(256)]


class Words(dict):
    """Encoded words; a missing one is encoded, and kept if it is short."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class WordBpe:
    """Encoder for vocabularies that lower-case, drop white space and mark word ends."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # A pair of ids as one number -> the rank of its merge and the new id as one number; larger means later.
        self.merges = {self.vocab[a] << ID | self.vocab[b]: rank << ID | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        self.words = regex.compile(rf"{contractions}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.ascii_words = re.compile(rf"{contractions}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.inner = [self.vocab.get(c, -1) for c in self.symbols]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in self.symbols]
        self.cache = Words(self.merge)

    def merge(self, word: str) -> bytes:
        """Token ids of one word, as the bytes of 32-bit integers. Bytes that the vocabulary lacks give no token."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [*map(self.inner.__getitem__, raw)]
        ids[-1] = self.final[raw[-1]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        n = len(ids)
        if n > 1:
            ids.append(-1)  # the end: no pair has it
            left, right = list(range(-1, n)), list(range(1, n + 1))
            find = self.merges.get
            queue = [found << PLACE | i for i in range(n - 1) if (found := find(ids[i] << ID | ids[i + 1])) is not None]
            heapq.heapify(queue)
            while queue:
                entry = heapq.heappop(queue)
                i, found = entry & ((1 << PLACE) - 1), entry >> PLACE
                if ids[i] < 0 or find(ids[i] << ID | ids[right[i]]) != found:
                    continue  # stale: a neighbour has merged since
                j = right[i]
                ids[i] = new = found & ((1 << ID) - 1)
                ids[j], right[i] = -1, (k := right[j])
                left[k] = i
                if (later := find(new << ID | ids[k])) is not None:
                    heapq.heappush(queue, later << PLACE | i)
                if (h := left[i]) >= 0 and (later := find(ids[h] << ID | new)) is not None:
                    heapq.heappush(queue, later << PLACE | h)
            ids = [i for i in ids if i >= 0]
        return array("i", ids).tobytes()

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Character by character: no rule for a sigma at a word's end.
        return self.words.findall(text.replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text as the bytes of 32-bit integers, and the decoded string."""
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        ids: list[bytes] = []
        for part in parts:
            if part in self.special:
                ids.append(array("i", [self.special[part]]).tobytes())
            else:
                ids += map(self.cache.__getitem__, self.split(part))
        raw = b"".join(ids)
        return raw, self.decode(memoryview(raw).cast("i"))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def encode(df: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ids array<int> and decoded string for its column text.

    The vocabulary is a fixed file of a few MB; the driver reads it and broadcasts it, so executors need no copy.
    """
    with open(vocab_path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    state: list[WordBpe] = []

    def run(batch) -> list:
        import numpy as np
        import pyarrow as pa

        if not state:
            state.append(WordBpe(spec.value))
        offsets, flat, decoded = [0], [], []
        for t in common.text_of(batch, text):
            ids, string = state[0].encode(t)
            flat.append(ids)
            offsets.append(offsets[-1] + len(ids) // 4)
            decoded.append(string)
        values = pa.array(np.frombuffer(b"".join(flat), np.int32))
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(decoded, pa.string())]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return common.map_batches(df, run, fields, keep, rows=256)


def digests(encoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows; keep: further columns of theirs."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *(keep or []),
    )

import hashlib

import pytest

from blockloom.llm import bpe
from blockloom.llm.queries import vocabulary

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    return tokenizers.Tokenizer.from_file(vocabulary()), bpe.WordBpe(open(vocabulary(), encoding="utf-8").read())


def test_equals_the_library(both):
    library, own = both
    texts = [
        "", " ", "Hello, World's END!!", "a<|endoftext|>B <|startoftext|>", "<|endoftext", "x" * 3000, "don't we'll I'M 1234 ½ ²",
        "ΑΣ σς İstanbul ﬁ ǅ", "é é ẛ̣", "中文字 🙂🙃 ​﻿", "tab\tline\nvt\x0bfs\x1cnel\x85nbsp ideo　", "\x00\x01",
    ]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        raw, decoded = own.encode(text)
        ids = list(memoryview(raw).cast("i"))
        assert ids == want
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(ids)


def test_random_texts(both):
    import random

    library, own = both
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("aAbcdeE'sS 12éßΣ\n!-_<|>") for _ in range(rng.randint(0, 40)))
        assert list(memoryview(own.encode(text)[0]).cast("i")) == library.encode(text, add_special_tokens=False).ids


def test_awkward_rows(awkward, both):
    library = both[0]
    rows = bpe.digests(bpe.encode(awkward, vocabulary(), keep=["doc_id", "text"]), keep=["ids"]).collect()
    want = []
    for r in awkward.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False) if ids else ""
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted(want, key=key)


def test_empty_table(nothing):
    assert bpe.digests(bpe.encode(nothing, vocabulary())).count() == 0

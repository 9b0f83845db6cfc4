import hashlib
import os
import random
import time

import numpy as np
import pytest

from blockloom.llm import substrings


def plain(rows):
    seen, out = set(), {}
    for doc, raw in sorted({(i, (t or "").encode()) for i, t in rows if i is not None}):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(prose_text):
    rng, rows = random.Random(5), []
    shared = [prose_text(rng.randint(15, 60), i) for i in range(6)]
    for i in range(150):
        parts = [prose_text(rng.randint(1, 40), 1000 + i * 5 + k) if rng.random() < 0.6 else rng.choice(shared)[rng.randint(0, 30) :] for k in range(4)]
        rows.append((1000 - i * 3, rng.choice(["", " ", "\n"]).join(parts)))
    return [*rows, (5, rows[3][1]), (6, rows[4][1]), (7, "a" * 900), (8, "ab" * 200), (9, "a" * 130), (10, "\0" * 300), (11, "z" * 99), (12, "z" * 99), (13, "xyz" * 40 + "Q" + "xyz" * 60), (14, "é" * 120)]


@pytest.mark.parametrize("settings", [{}, {"GROUP": 3, "BLOCK_BYTES": 4000, "PIECE": 50, "OFTEN": 2}])
def test_equals_plain(spark, prose_text, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(substrings, name, value)
    rows = passages(prose_text)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digests(substrings.remove_repeats(docs)).collect()}
    assert got == plain(rows)


def test_awkward(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = plain(rows)
    got = substrings.digests(substrings.remove_repeats(awkward)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_removed == 0 if r.doc_id is None else tuple(r)[1:] == want[r.doc_id]
    assert substrings.remove_repeats(nothing).count() == 0


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc ", bytes(range(97, 123)), b"a"])
        base = bytes(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        raw = base + base[: rng.randint(0, len(base))] + base
        data = np.frombuffer(raw + b"\0" * (substrings.LENGTH + 8), np.uint8)
        wanted = np.zeros(len(data), bool)
        wanted[: len(raw)] = np.random.default_rng(1).random(len(raw)) < rng.choice([0.2, 0.7, 1])
        order, packed = substrings.suffix_order(data, wanted)
        keys = [bytes(data[i : i + 100]) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        shared = [len(os.path.commonprefix([a, b])) for a, b in zip(keys[:-1], keys[1:])]
        assert substrings.common_prefixes(order, packed)[1:].tolist() == shared


def test_long_runs(spark):
    """Two megabytes of one character, and of a period of three, in linear time."""
    rows = [(1, "a" * 2_000_000), (2, "abc" * 700_000), (3, "b" + "a" * 150)]
    began = time.perf_counter()
    got = {r.doc_id: tuple(r)[1:4] for r in substrings.digests(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert time.perf_counter() - began < 60
    assert got == {1: (2_000_000, 1_999_999, 1), 2: (2_100_000, 2_099_997, 1), 3: (151, 150, 1)}


def test_ids_of_several_texts(spark, prose_text):
    """Of an id's texts the smallest is compared and cut; the others stay whole."""
    a, b = "A" + prose_text(60, 71), "B" + prose_text(60, 72)
    rows = [(1, a), (1, b), (1, a), (2, a + " tail"), (3, b + " tail2"), (4, a), (4, a)]
    got = sorted(tuple(r) for r in substrings.digests(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect())
    want = plain([(1, a), (2, a + " tail"), (3, b + " tail2"), (4, a)])
    whole = (1, len(b), 0, 0, hashlib.sha256(b.encode()).hexdigest())
    assert got == sorted([(1, *want[1]), (1, *want[1]), whole, (2, *want[2]), (3, *want[3]), (4, *want[4]), (4, *want[4])])

import random
import re
from collections import Counter

import numpy as np
import pytest

from blockloom.llm import ngram_join, shingles
from blockloom.llm import components as components_module
from blockloom.llm.components import components
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain(rows):
    sets = {i: grams(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in ids}


def copies(prose_text, n=260):
    rng, out = random.Random(7), []
    bases = [prose_text(rng.choice([6, 30, 90, 200]), 100 + i) for i in range(12)]
    shared = prose_text(25, 999)
    for i in range(n):
        w = rng.choice(bases[: 3 if i % 2 else 12]).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        text = " ".join(w)
        out.append((i * 3 + 1, text.upper() if i % 17 == 0 else text + " " + shared if i % 5 == 0 else text))
    return out


@pytest.mark.parametrize("settings", [{}, {"BLOCK_GRAMS": 900, "CHUNK_GRAMS": 300, "MEETINGS": 50, "RUN_ROWS": 6, "MOST_PIVOTS": 5, "HOT": 1000}, {"HOT": 3}])
def test_equals_plain(spark, prose_text, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = copies(prose_text)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()}
    assert got == plain(rows)


def test_awkward(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want, got = plain(rows), ngram_join.link(awkward).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_join.link(nothing).count() == 0


def test_hashes_stand_for_grams(prose_text):
    texts = [prose_text(random.Random(i).randint(0, 50), i % 9) for i in range(300)] + ["", " ", "A b\tC\nd\x0be", "é é é é é", "x" * 100_000]
    found = shingles.sets([t.encode() for t in texts])
    names = {}
    for t, s in zip(texts, found, strict=True):
        g = grams(t)
        assert len(s) == len(g) and np.all(s[:-1] < s[1:])
        names.setdefault(frozenset(g), s.tobytes())
        assert names[frozenset(g)] == s.tobytes()
    assert len({x for x in names.values()}) == len(names)


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(2**9)] + [(5000 + rng.randrange(300), 5000 + rng.randrange(300)) for _ in range(200)] + [(5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(600):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {i: r for i, r in label.items() if i != r}
    assert Counter(got.values())[0] == 2**9


def test_linked_sets_share_a_fragment_key():
    rng = np.random.default_rng(5)
    for percent in (70, 80, 85):
        for _ in range(400):
            n = int(np.exp(rng.uniform(0, 6.5)))
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            n = len(base)
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            most = (n - gone) * 100 // percent - n  # new ones that still leave the pair linked
            other = np.union1d(rng.permutation(base)[gone:], rng.integers(0, 1 << 63, max(0, most), dtype=np.uint64) * np.uint64(2))
            common = len(np.intersect1d(base, other))
            if 100 * common >= percent * (n + len(other) - common):
                hot = np.sort(rng.permutation(np.union1d(base, other))[: rng.integers(0, len(base) + 1)])
                one, two = (ngram_join.fragment_keys(x, percent, hot) for x in (base, other))
                assert len(np.intersect1d(one[0], two[0])) or len(np.intersect1d(one[1], two[1]))


def test_keys_of_empty_fragments_are_rare():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(50, 900)), dtype=np.uint64) * np.uint64(2)) for _ in range(300)]
    for percent in (80, 85):
        keys, counts = np.unique(np.concatenate([ngram_join.fragment_keys(s, percent)[0] for s in sets]), return_counts=True)
        assert (counts > 1).sum() < 0.01 * len(keys)  # unlike sets


def test_runs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RUN_ROWS", 9)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("1", "4", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            # Token k is in k ids of sizes 10, and in one that is too large to be linked.
            rows = [(k, 0, 10, 100 * k + i) for k in range(1, 25) for i in range(k)] + [(k, 0, 99, 100 * k + 99) for k in range(1, 25)] + [(7, 1, 10, 5), (7, 1, 12, 6)]
            found = ngram_join.runs(spark.createDataFrame(rows, "token long, mark int, n int, id long"), 85).collect()
            got = {k: {(r.a, r.b) for r in found if r.kind == k} for k in (1, 2, 3, 4)}
            assert got[2] == {(100 * k + i, 100 * k + j) for k in range(2, 5) for i in range(k) for j in range(i + 1, k)}
            assert got[3] == {(100 * k, 100 * k + i) for k in range(5, 10) for i in range(k)}
            assert got[1] == {(100 * k, 100 * k + i) for k in range(10, 25) for i in range(k)}
            assert got[4] == {(7, 5), (7, 6)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(np.exp(rng.uniform(1, 8)))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = [base, np.union1d(base[: len(base) - len(base) // 11], rng.integers(0, 1 << 63, len(base) // 11, dtype=np.uint64)), np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))]
        label = ngram_join.possible([ngram_join.sketch(s) for s in sets], np.array([len(s) for s in sets]), 80)
        assert label[0] == label[1] and (label[2] != label[0] or n < 20)


def test_ids_of_several_rows(spark, prose_text):
    a, b = prose_text(80, 1), prose_text(80, 2)
    rows = [(1, a), (1, a), (2, a + " x"), (2, a + " x"), (3, b), (4, b + " y"), (4, b + " y")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_pairs_below_the_threshold_are_seldom_counted(spark, monkeypatch):
    """Sets that differ in a few n-grams more than linked ones are ruled out before their overlaps are counted."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(260)]
    rows = []
    for i in range(60):  # three edits of four n-grams each: most pairs are just below 84 %
        w = list(base)
        for at in rng.sample(range(4, 256), 3):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    counted, plain_counts = [], ngram_join.partial_overlaps

    def counts(*args):
        out = ngram_join.common.saved(plain_counts(*args), "counts")
        counted.append(out.groupBy("u", "v", "n_u", "n_v").sum("c").selectExpr("`sum(c)` * 100 >= (n_u + n_v - `sum(c)`) * 84 AS linked").groupBy("linked").count().collect())
        return out

    monkeypatch.setattr(ngram_join, "partial_overlaps", counts)
    ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 84).collect()
    found = Counter()
    for rounds in counted:
        found.update({r["linked"]: r["count"] for r in rounds})
    assert found[False] < 300


def test_rows_of_keys_are_two_numbers(spark):
    """What the exchange of keys moves; sizes keep enough bits, and no linked sizes are parted."""
    keys = spark.createDataFrame([(5, 0, 10, 1)], "token long, mark int, n int, id long")
    node = ngram_join.runs(keys, 85)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "RepartitionByExpression":
        node = node.children().head()
    assert node.output().size() == 2
    sizes = [1, 2047, 2048, 4095, 4096, 4097, 99_999, 1_234_567, (1 << 31) - 1]
    found = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", ngram_join.size_code(F.col("n")).alias("c"), ngram_join.code_size(ngram_join.size_code(F.col("n"))).alias("m")).collect()
    assert all(0 < r.c < 1 << ngram_join.SIZE_BITS and r.m <= r.n <= r.m + (r.m >> 11) for r in found)
    small, large = 85_000 * 17 - 1, 100_000 * 17 - 1  # just linked, and codes round the larger one down less
    rows = [(3, 0, small + 1, 1), (3, 0, large, 2), (9, 0, 100, 3), (9, 0, 118, 4)]
    got = ngram_join.runs(spark.createDataFrame(rows, "token long, mark int, n int, id long"), 85).collect()
    assert {(r.kind, r.a, r.b) for r in got} == {(2, 1, 2)}


def test_sieved_joins_equal_plain_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 9 else None, str(i)) for i in range(300)], "doc_id long, text string")
    ids = spark.range(0, 400, 7).withColumnRenamed("id", "doc_id")
    for words in (1, 1 << 17):
        monkeypatch.setattr(ngram_join.common, "SIEVE_WORDS", words)
        for ours, kind in ((ngram_join.common.among, "left_semi"), (ngram_join.common.not_among, "left_anti")):
            assert sorted(map(str, ours(rows, ids, "doc_id").collect())) == sorted(map(str, rows.join(ids, "doc_id", kind).collect()))
    assert ngram_join.common.sieved(rows, ids, "doc_id").filter("__maybe").count() < 60

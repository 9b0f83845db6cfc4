import math
import random
import re
import zlib
from collections import Counter

from blockloom.llm import mixing, sharding


def test_targets():
    assert mixing.targets([10, 10, 1000], [5, 2, 1]) == [30.0, 30.0, 960.0]
    assert mixing.targets([100, 100, 100], [1, 1, 1]) == [100.0] * 3
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_mix_awkward(awkward):
    rows = mixing.mix(awkward, keep=["size", "lang", "text"]).collect()
    assert len(rows) == awkward.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=key) == sorted(((r.doc_id, size(r.text)) for r in awkward.collect()), key=key)
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    again = mixing.mix(awkward.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_mix_reaches_targets(spark, prose_text):
    rng = random.Random(3)
    docs = [(i, prose_text(rng.randint(1, 120), i), rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    source = {d[0]: d[2] for d in docs}
    taken, target, total = Counter(), {}, 0
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        total += r["size"]
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(150, 0.005 * t)


def test_mix_empty(nothing):
    assert mixing.mix(nothing).count() == 0


def test_shuffle_awkward(awkward):
    rows = sharding.shuffle(awkward).collect()
    base = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in awkward.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == base
    check_slots(rows, 16)


def check_slots(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shuffle_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    docs = spark.range(3001).selectExpr("id AS doc_id", "concat('t', id % 5) AS text")
    rows = sharding.shuffle(docs, seed=1).collect()
    check_slots(rows, 16)
    assert Counter((r.doc_id, r["shard"], r["slot"]) for r in rows) == Counter((r.doc_id, r["shard"], r["slot"]) for r in sharding.shuffle(docs.repartition(5), seed=1).collect())
    other = {r.doc_id: r["shard"] for r in sharding.shuffle(docs, seed=2).collect()}
    assert sum(other[r.doc_id] == r["shard"] for r in rows) < 400


def test_matrix_is_exact_and_hypergeometric():
    rows = sharding.communication_matrix([5, 0, 7, 9], [6, 5, 5, 5], 3)
    assert [sum(r) for r in rows] == [5, 0, 7, 9] and [sum(c) for c in zip(*rows)] == [6, 5, 5, 5]
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    mean = sum(draws) / len(draws)
    spread = sum((x - mean) ** 2 for x in draws) / len(draws)
    assert abs(mean - 6) < 0.05 and abs(spread - 20 * 0.3 * 0.7 * 80 / 99) < 0.12


def test_shuffle_empty(nothing):
    assert sharding.shuffle(nothing).count() == 0


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    docs = spark.range(2000).selectExpr("CASE WHEN id < 900 THEN 7 ELSE id END AS doc_id", "CASE WHEN id < 900 THEN 'same' ELSE 'other' END AS text").repartition(6)
    rows = sharding.shuffle(docs).collect()
    check_slots(rows, 16)
    shards = Counter(r["shard"] for r in rows if r.doc_id == 7)
    assert len(rows) == 2000 and len(shards) == 16 and max(shards.values()) < 100


def test_mix_equals_a_plain_solver(spark):
    rng = random.Random(8)
    docs = [(i, "w " * int(rng.paretovariate(1.2) * 3), rng.choice(["b", "a", "é", None, "Z"])) for i in range(400)] + [(1000, "", "a"), (1001, None, "b"), (1002, "w " * 300, "Z")]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    keys = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {k: [len((t or "").split()) for _, t, s in docs if s == k] for k in keys}
    goals = dict(zip(keys, mixing.targets([sum(sizes[k]) for k in keys], [mixing.WEIGHTS[i % 3] for i in range(len(keys))])))
    of = {i: s for i, _, s in docs}
    for r in rows:
        assert r.source_size == sum(sizes[of[r.doc_id]]) and abs(r.target - goals[of[r.doc_id]]) <= 1e-6 * r.target
    for k in keys:
        if goals[k] >= 3 * sum(sizes[k]):
            assert all(r.copies == 3 for r in rows if of[r.doc_id] == k and r["size"])
            continue
        mean = sum(sizes[k]) / len(sizes[k])
        rate = lambda lam, n: 3 / (1 + 2 * math.exp(-max(-700.0, min(700.0, lam * n / mean))))  # noqa: E731, B023
        low, high = -1e4, 1e4
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(n * rate(lam, n) for n in sizes[k]) < goals[k] else (low, lam)
        off = [abs(r.copies - rate(lam, r["size"])) for r in rows if of[r.doc_id] == k and r["size"]]
        assert sum(x < 1 + 1e-6 for x in off) >= 0.8 * len(off) and max(off) < 2  # rounded, and a few shifted by one


def test_mix_has_any_number_of_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 9 AS INT)) AS text", "concat('host', id % 700) AS source")
    rows = mixing.mix(docs).collect()
    keys = sorted({f"host{i % 700}" for i in range(3000)})
    sizes = Counter()
    for i in range(3000):
        sizes[f"host{i % 700}"] += 1 + i % 9
    goals = dict(zip(keys, mixing.targets([sizes[k] for k in keys], [mixing.WEIGHTS[i % 3] for i in range(700)])))
    assert len(rows) == 3000 and all(abs(r.target - goals[f"host{r.doc_id % 700}"]) < 1e-6 * r.target for r in rows)


def test_plain_matrix_and_slots(spark):
    """The shards of a run follow from the drawn matrix: block by block, counts are those of the matrix."""
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text")
    rows = sharding.shuffle(docs, seed=4).collect()
    check_slots(rows, 16)
    name = spark.createDataFrame([(r.doc_id, r["size"], r.text_crc32) for r in rows], "doc_id long, size long, text_crc32 long")
    blocks = {r.doc_id: r.block for r in name.selectExpr("doc_id", "pmod(xxhash64(xxhash64(doc_id, text_crc32, size), 4), 16) AS block").collect()}
    sizes = Counter(blocks.values())
    matrix = sharding.communication_matrix([sizes[b] for b in range(16)], [(500 + 15 - s) // 16 for s in range(16)], 4)
    got = Counter((blocks[r.doc_id], r["shard"]) for r in rows)
    assert all(got[b, s] == matrix[b][s] for b in range(16) for s in range(16))

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def plain(rows, is_query, k, quantize):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and (quantize or v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in usable:
        if not is_query(q):
            continue
        scored = []
        for i, b in usable:
            if i != q and len(a) == len(b):
                s = sum(int(np.floor(1024 * float(np.float32(x)))) * int(np.floor(1024 * float(np.float32(y)))) for x, y in zip(a, b)) if quantize else sum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, b))
                scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    data = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(900)]
    common = rng.standard_normal(8).astype(np.float32).tolist()
    data += [(i, common) for i in range(900, 1100)]
    return data + [(2000, None), (2001, []), (2002, [None] + [1.0] * 7), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [0.0] * 8), (None, common), (2006, [1.0, 2.0]), (2020, [1.5, -2.0]), (2040, [0.5, 0.5]), (2050, [])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def test_exact_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    got = {}
    for r in topk.search(table(spark, rows), F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in plain(rows, lambda i: i % 50 == 0, 10, True).items() if v}


def test_large_components(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, -5.5]), (2, [-2.5e6, 0.25]), (3, [1.0, 2.0]), (4, [0.0, 2e12]), (100, [0.0, 1e-3]), (200, [1e290, 0.0, 0.0]), (201, [0.0, 1.0, 2.0])]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = lambda v: [int(np.floor(1024 * x)) if abs(x) < 1e15 else int(x) * 1024 for x in v]
    want = {}
    for q, a in rows:
        if q % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(whole(a), whole(b))), i) for i, b in rows if i != q and len(a) == len(b)]
            want[q] = [(i, -x) for x, i in sorted(scored)]
    assert got == want
    with pytest.raises(Exception, match="fit a long"):
        topk.search(spark.createDataFrame([(0, [1e20]), (1, [1e20])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_tree_boxes_cover_all_rows():
    points = np.random.default_rng(0).integers(-5, 5, (1000, 3))
    leaves = topk.build_tree(points, 16)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 16


def test_ann_recall_and_ties(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 9)
    own = rows
    want = plain([x for x in own if x[1] is None or any(x[1])], lambda i: i % 20 == 0, 20, False)
    got = {}
    for r in ann.search(table(spark, own), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in want.items() if v}
    assert got[2020] == want[2020] and got[2040] == want[2040]  # vectors of another length have their own index
    hits = [len({i for i, _ in got[q]} & {i for i, _ in v}) / len(v) for q, v in want.items()]
    assert np.mean(hits) >= 0.9 and set(got) == set(want)
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({i for i, _ in found}) == len(found)


@pytest.mark.parametrize("noise", [0.05, 0.12])
def test_every_query_of_a_clustered_table_has_k_rows(spark, noise):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 16))
    points = centres[rng.integers(0, 60, 6000)] + noise * rng.standard_normal((6000, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    router = ann.Router(points, 20, 0.95)
    assert router.parts == 64 and router.probes < router.parts / 2
    table_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(table_, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, 6000, 20)) and {len(v) for v in got.values()} == {20}
    near = points[::20] @ points.T
    near[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(got[20 * i]) & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9


def test_few_vectors_besides_repeated_queries(spark):
    rows = [(20, [1.0, float(i % 3)]) for i in range(150)] + [(i, [float(i % 7) + 1, 1.0]) for i in range(101, 119)]
    got = {}
    for r in ann.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got[20]) == list(range(101, 119))  # all candidates, if they are fewer than k


def test_parts_are_balanced():
    points = np.random.default_rng(2).standard_normal((512, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    label = ann.balanced_parts(512, *ann.neighbour_graph(points), 8)
    assert np.bincount(label).tolist() == [64] * 8


def test_empty(spark):
    for f in (topk.search, ann.search):
        assert f(table(spark, []), F.col("vec_id") % 2 == 0).count() == 0
        assert f(table(spark, [(2, [1.0, 2.0])]), F.col("vec_id") % 2 == 0).count() == 0

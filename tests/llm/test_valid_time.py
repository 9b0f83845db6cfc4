import math
import random
import zlib
from datetime import datetime, timedelta

from blockloom.llm import valid_time

START = datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double"


def plain(sales, changes):
    """The contract, batch after batch, with all versions in lists."""
    number = lambda day: max(0, min(7, (day - 19723) * 8 // 152))
    days = lambda t: (t - datetime(1970, 1, 1)).days
    come = [[] for _ in range(8)]
    for s in sales:
        come[7 if s[4] is None else number(days(s[4]))].append(s)
    new = [[] for _ in range(8)]
    for c in {c for c in changes if c[4] is not None}:
        new[7 if c[0] is None else number(days(c[4]) + zlib.crc32(str(c[0]).encode()) % 4)].append(c)
    low = lambda x: (x is not None, x if x is not None else 0)
    order = lambda c: (c[4], low(c[2]), low(c[0]), (c[3] is not None, c[3] or ""), low(c[5]))
    out, waiting, held = [], [], {}
    marks = [None, None]

    def emit(sale, batch):
        mine = held.get(sale[1], []) if sale[1] is not None else []
        fit = [c for c in mine if sale[3] is not None and c[4] <= sale[3]]
        best = max(fit, key=order, default=None)
        cents = None if best is None or best[5] is None else math.floor(100 * best[5] + 0.5)
        out.append(("sale", sale[0], batch, len(mine), best and best[0], cents, best and best[3]))

    for batch in range(8):
        before = [None if m is None else m - timedelta(hours=12) for m in marks]
        h = None if None in before else min(before)
        for c in new[batch]:
            if before[1] is not None and c[4] < before[1]:
                out.append(("late", c[0], batch, None, None, None, None))
            else:
                held.setdefault(c[1], []).append(c)
        stay = []
        for s in waiting + come[batch]:
            if s[3] is None or h is not None and s[3] < h:
                emit(s, batch)
            else:
                stay.append(s)
        waiting = stay
        for client, mine in held.items():
            passed = sorted((c for c in mine if h is not None and c[4] <= h), key=order)
            held[client] = passed[-1:] + [c for c in mine if h is None or c[4] > h]
        marks[0] = max([x for x in [marks[0], *[s[3] for s in come[batch]]] if x is not None], default=None)
        marks[1] = max([x for x in [marks[1], *[c[4] for c in new[batch]]] if x is not None], default=None)
    for s in waiting:
        emit(s, 8)
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    at = lambda: START + timedelta(hours=rng.randrange(24 * 120))
    client = lambda: rng.choice([7, 7, 7, 1, 2, 3, 4, None, 900 + rng.randrange(40)])
    changes = [(i, client(), rng.choice([None, 0, 1]), rng.choice(["I", "U", "D", None]), rng.choice([at(), at(), at(), START + timedelta(days=19)]), rng.choice([None, 12.345, -0.005, float(i)])) for i in range(500)]
    changes += changes[:30] + [(3, 7, 5, "U", changes[3][4], 1.0), (None, 7, 0, "U", at(), 2.0), (None, None, None, None, at(), None), (501, 2, 0, "I", None, 1.0)]
    sales = []
    for i in range(600):
        sold = rng.choice([at(), at(), at(), at(), changes[i % 500][4], START + timedelta(days=19), None])
        late = timedelta(hours=rng.choice([0, 1, 5, 24 * 30]))
        arrived = (sold or at()) + late
        sales.append((i, client(), 1.0, sold, arrived if not 19 * 3 <= (arrived - START).days < 19 * 4 else None))  # no arrivals in batch 3
    return sales + sales[:20] + [(None, 7, None, at(), at()), (None, None, None, None, None)], changes


def run(spark, sales, changes):
    s, c = spark.createDataFrame(sales, SALES).selectExpr("*", "'b' AS batch", "'k' AS key", "1 AS row_id", "2 AS ways"), spark.createDataFrame(changes, CHANGES)
    found = valid_time.enrich(s.repartition(3), c.selectExpr("*", "'x' AS at", "'g' AS gate"))
    assert found.columns == ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(valid_time, "LEAST_KEYS", 3)
    monkeypatch.setattr(valid_time, "CHUNK", 50)
    sales, changes = rows()
    split = valid_time.split_clients(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), len(sales) + len(changes))
    assert {r.client_id for r in split.collect() if r.ways > 5} == {7}
    assert run(spark, sales, changes) == plain(sales, changes)


def test_no_changes(spark, monkeypatch):
    monkeypatch.setattr(valid_time, "LEAST_KEYS", 1)
    sales = [(1, 2, None, START, START), (2, 2, None, None, START + timedelta(days=200))]
    assert run(spark, sales, []) == plain(sales, []) == [("sale", 1, 8, 0, None, None, None), ("sale", 2, 7, 0, None, None, None)]


def test_one_stage_with_state_in_the_heap(spark, monkeypatch):
    """Each start opens one state store a partition, and none has memory beside the heap."""
    monkeypatch.setattr(valid_time, "LEAST_KEYS", 1)
    feed, seen = valid_time.feed, []
    monkeypatch.setattr(valid_time, "feed", lambda *a: seen.append(feed(*a).lastProgress))
    changes = [(1, 2, 0, "U", START, 1.5)]
    sales = [(1, 2, None, START + timedelta(hours=1), START), (2, 2, None, START - timedelta(hours=1), START + timedelta(days=200))]
    assert run(spark, sales, changes) == plain(sales, changes)
    operators = [p["stateOperators"] for p in seen]
    assert len(seen) == 8 and all(len(x) == 1 for x in operators)
    assert not any(k.startswith("rocksdb") for x in operators for k in x[0]["customMetrics"])

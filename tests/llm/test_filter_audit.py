import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from blockloom.llm import filter_audit

COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plain(docs, labels):
    """Every filter applied to every document in every order."""
    failing = []
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs) else set()
        good = any(i == doc_id and q == 1 for i, q, _ in labels) and doc_id is not None
        toxic = any(i == doc_id and x == 1 for i, _, x in labels) and doc_id is not None
        failing.append((source or "", fails, good, toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failing}:
        for order in permutations("ABCDE"):
            there = [x for x in failing if x[0] == part]
            left = list(range(len(there)))
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in there[i][1]]
                redundant = sum(letter in x[1] for i, x in enumerate(there) if i not in left)
                left = [i for i in left if i not in gone]
                shapley[part, letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {letter} for x in there), sum(there[i][2] for i in gone), sum(there[i][3] for i in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("m")).withColumn("part", F.lit("p")).withColumn("good", F.lit(1)).repartition(3)
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = found.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows}


def cases(prose):
    rich = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n", rich, rich, rich + "#", prose(30, 1), prose(90, 2), prose(90, 2), "AB " * 60, "é" * 30 + " x", rich + " " + "x" * 1500, rich + " " + "x" * 1499 + "y", prose(30_000, 3), "a|b", rich.upper()]
    docs = [(i, t, (None, "", "s1", "s2")[i % 4]) for i, t in enumerate(texts)]
    docs += [(20 + i, t, "s1") for i, t in enumerate(texts[3:14])] + [docs[3], docs[4], (3, "other text", "s2"), (None, rich, "s2"), (None, None, None)]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (5, 1, 1), (21, 1, 1), (None, 1, 1), (9, None, 1), (9, None, 1), (500, 1, 1)]
    return docs, labels


def test_equals_applying_every_order(spark, prose_text):
    docs, labels = cases(prose_text)
    assert run(spark, docs, labels) == plain(docs, labels)


def test_different_texts_in_one_class(spark, prose_text, monkeypatch):
    docs, labels = cases(prose_text)
    monkeypatch.setattr(filter_audit, "classes", lambda text: [F.xxhash64(F.length(text) % 2)])
    assert run(spark, docs, labels) == plain(docs, labels)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_no_rows(spark, labels):
    assert run(spark, [], labels) == {}

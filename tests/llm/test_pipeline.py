import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from blockloom.llm import mixing, quality  # noqa: E402

from test_ngram_join import plain  # noqa: E402
from test_ngram_join import grams  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose_text):
    rows = [(i, prose_text(30 + i % 50, i), "en", f"s{i % 4}", 1, 0.1, 5) for i in range(120)]
    rows = [(i, " ".join(w.upper() + "!!" for w in t.split()) if i % 6 == 0 else t, *r) for i, t, *r in rows]
    rows += [(500 + i, rows[i][1] + (" end" if i % 2 else "") + " mail me@x.org", *rows[i][2:]) for i in range(1, 40)]
    rows += [rows[1], (900, None, None, None, None, None, None), (901, "", "en", "s1", 0, 0.1, 5), (None, rows[7][1], "en", "s1", 0, 0.1, 5)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Score double, size int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 0 else 1) for i in range(120)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), check in zip(pipeline.STAGES, (check_quality, check_near, check_pii, check_mix, None), strict=True):
        out = pipeline.common.saved(stage(spark, docs, folder), "test")
        if check:
            assert out.columns == columns, name
            check(spark, docs, out, folder)
        docs = out
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(docs.columns)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids_sha256)
    assert sorted(pipeline.run(spark, folder).collect(), key=key) == sorted(docs.collect(), key=key)


def check_quality(spark, docs, out, folder):
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs.drop("Score"), model).filter("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == want and all(i not in want for i in range(0, 120, 6)) and 7 in want
    assert out.filter("Score = 0.1").count() > 100


def check_near(spark, docs, out, folder):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(i for i, (_, c) in plain(rows).items() if i == c) + [None] * sum(i is None for i, _ in rows)
    assert sorted((r.doc_id for r in out.collect()), key=lambda i: (i is None, i or 0)) == want


def check_pii(spark, docs, out, folder):
    assert out.count() == docs.count() and out.filter("text LIKE '%me@x.org%'").count() == 0


def check_mix(spark, docs, out, folder):
    want = {r.doc_id: r.copies for r in mixing.mix(docs.drop("size")).collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def near_pairs(prose_text):
    """Texts and edits of them (a tail, scattered words) at five-word similarities around 0.8."""
    rng, rows = random.Random(3), []
    for i in range(60):
        base = prose_text(40 + 4 * i, 7000 + i).split()
        if i % 2:
            other = base + prose_text(round(len(base) * (0.10 + 0.01 * (i % 20))), 8000 + i).split()
        else:
            other = list(base)
            for k in rng.sample(range(len(base)), 1 + len(base) // (35 + i % 20)):
                other[k] = f"edit{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    at = prose_text(100, 9000).split()  # 80 shingles of 100: exactly the threshold
    return [*rows, (500, " ".join(at[:84])), (501, " ".join([*at, "a", "b", "c", "d"]))]


def test_near_copies_take_five_words_and_80_percent(spark, prose_text):
    rows = near_pairs(prose_text)
    sets = {i: grams(t, 5) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    links = [p for p, x in alike.items() if x >= 0.8]
    assert alike[500, 501] == 0.8 and sum(x < 0.85 for x in map(alike.get, links)) > 5 and sum(0.7 < x < 0.8 for x in alike.values()) > 5
    label = {i: i for i in sets}
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    out = pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in label.items() if i == c)

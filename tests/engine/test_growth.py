"""What a query costs as its tables grow, read from its plan."""

import json
import random

from blockloom.functions import text as t
from blockloom.operators import blocks as B
from blockloom.operators import requirements as R
from blockloom.operators import strict, tables, validate
from blockloom.sources import adapters as A
from blockloom.sources import rules as S
from pyspark.sql import functions as F

BLOCKS = "document_id long, block_order long, kind string, style string, text string"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_style_is_folded_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, "paragraph", "Heading 1", "1 Scope")], BLOCKS).write.parquet(str(tmp_path / "b"))
    base = B.classified(spark.read.parquet(str(tmp_path / "b")), S.style_rules(spark, S.LINE_STYLES), S.ENGLISH)
    assert plan_of(base).count("octet_length(") == 1


def test_folding_of_ascii_one_and_several(spark):
    words = ["Heading", "Straße", "ΜΆΪΟΣ", "ﬁn ſ", "ß" * 3, "", "ŉ𐐀"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select(t.folded(F.col("w")).alias("f")).collect()
    assert [r.f for r in found] == [w.casefold() for w in words]


def test_strict_reading_is_one_pass(spark, tmp_path):
    good = {"document_id": 1, "blocks": [{"block_id": "b1", "block_order": 1, "zone": "main_body", "block_type": "paragraph"}]}
    bad = {"document_id": 2, "blocks": [{"block_id": None, "block_order": "1", "zone": "x", "block_type": "paragraph"}, 3, {"odd": 1, "flags": ["no"]}], "source": {"template_id": 1}, "styles": None}
    rows = [("a", json.dumps(good)), ("b", json.dumps(bad)), ("c", "[1]"), ("d", None), ("e", '{"document_id": 1, "blocks": null}')]
    spark.createDataFrame(rows, "name string, json string").write.parquet(str(tmp_path / "d"))
    documents, found = strict.read_documents(spark.read.parquet(str(tmp_path / "d")))
    assert plan_of(found).count("Relation [") == 1 and plan_of(documents).count("Relation [") == 1
    assert [(r.document_id, r.block_id) for r in documents.collect()] == [(1, "b1")]
    assert {tuple(r) for r in found.collect()} == {
        ("b", "blocks[0].block_id", "wrong type: VOID"), ("b", "blocks[0].block_order", "wrong type: STRING"), ("b", "blocks[0].zone", "unknown value"),
        ("b", "blocks[1]", "wrong type: BIGINT"), ("b", "blocks[2].odd", "unknown key"), ("b", "blocks[2].flags", "unknown value"),
        *[("b", f"blocks[2].{k}", "missing key") for k in ("block_id", "block_order", "zone", "block_type")],
        ("b", "source.template_id", "wrong type: BIGINT"), ("b", "source.path", "missing key"),
        ("c", "", "not a JSON object"), ("d", "", "not a JSON object"), ("e", "blocks", "wrong type: VOID"),
    }


def test_tables_in_arrays_equal_positions_and_sort_no_positions(spark, tmp_path):
    rng, rows = random.Random(5), []
    for doc in range(20):
        for r in range(rng.randint(1, 6)):
            row = [(place, rng.choice([1, 1, 2, 3, None]), rng.choice([None, "restart", "continue", "continue"]), rng.choice([f" {r}-{place}", "", None])) for place in range(rng.randint(1, 5))]
            rows.append((doc, r, row))
    spark.createDataFrame(rows, "document_id long, row long, cells array<struct<place:long,span:long,merge:string,text:string>>").write.parquet(str(tmp_path / "r"))
    written = spark.read.parquet(str(tmp_path / "r"))
    held = tables.laid_out(written)
    laid = tables.layout(written.select("document_id", "row", F.explode("cells").alias("c")).select("document_id", "row", "c.*"))
    for made in (tables.spans, tables.grid, tables.grid_cells):
        assert sorted(map(str, made(held).collect())) == sorted(map(str, made(laid).collect()))
        assert "Window" not in plan_of(made(held)) and plan_of(made(held)).count("Aggregate [") == 1


def _base(spark, path):
    rows = [(1, 1, "paragraph", "Heading 1", "1 Scope"), (1, 2, "paragraph", "Normal", "The clerk agrees with the form, if asked; the owner starts from it:"), (1, 3, "paragraph", "List dash", "- forms of all kinds;"), (1, 4, "paragraph", "Normal", "The owner works by hand with care.")]
    spark.createDataFrame(rows, BLOCKS).write.parquet(path)
    return B.analysed(spark.read.parquet(path), S.style_rules(spark, S.LINE_STYLES), S.ENGLISH)


def test_questions_lead_back_to_blocks_without_a_join(spark, tmp_path):
    base = _base(spark, str(tmp_path / "b"))
    found = R.records(R.candidates(base, S.ENGLISH), S.ENGLISH)
    applied, _ = R.apply_baseline(found, S.ENGLISH)
    asked = R.questions(R.question_rows(applied, S.ENGLISH))
    carried = R.carried_lineage(asked)
    assert plan_of(carried).count("Relation [") == 1
    ids = carried.columns
    want = {tuple(r) for r in R.lineage(asked, applied, found, base).select(ids).collect()}
    assert want and {tuple(r) for r in carried.collect()} == want


def test_baseline_decisions_without_a_join(spark, tmp_path):
    found = R.records(R.candidates(_base(spark, str(tmp_path / "b")), S.ENGLISH), S.ENGLISH)
    made = R.baseline_decisions(found)
    assert plan_of(made).count("Relation [") == 1
    want = {str(tuple(r)) for r in R.decisions(R.review_cases(found), found).select(made.columns).collect()}
    assert want and {str(tuple(r)) for r in made.collect()} == want


def test_hints_match_each_pattern_twice(spark, tmp_path):
    spark.createDataFrame([("The clerk with care, if asked", "obligation")], "x string, kind string").write.parquet(str(tmp_path / "h"))
    out = spark.read.parquet(str(tmp_path / "h")).select(R.hints(F.col("x"), F.col("kind") == "contextual_obligation", S.ENGLISH).alias("h"))
    assert plan_of(out).count(t.cut_at_word(S.ENGLISH.conditions)) == 2
    assert tuple(out.first().h) == ("The clerk", "care", None, "if asked")


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"line {i}\n" * 50) for i in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    documents = A.read_table(spark, str(tmp_path), "documents")
    blocks = A.line_blocks(documents)
    assert plan_of(A.by_document(blocks, documents)) == plan_of(blocks)
    monkeypatch.setattr(A, "PART_BYTES", 500)
    dealt = A.by_document(blocks, documents)
    assert plan_of(dealt).startswith("RepartitionByExpression [document_id") and dealt.rdd.getNumPartitions() > 10
    base = B.analysed(dealt, S.style_rules(spark, S.LINE_STYLES), S.ENGLISH)
    assert base.rdd.getNumPartitions() == dealt.rdd.getNumPartitions()
    here = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    own = A.line_blocks(here)
    assert plan_of(A.by_document(own, here)) == plan_of(own)


def test_batch_reads_checks_once(spark, tmp_path):
    rows = [(1, "a", "passed"), (1, "b", "failed"), (2, "a", "passed"), (2, "b", "warning"), (3, "a", "failed"), (3, "b", "failed")]
    spark.createDataFrame(rows, "document_id long, name string, status string").write.parquet(str(tmp_path / "c"))
    checks = spark.read.parquet(str(tmp_path / "c"))
    issues = spark.createDataFrame([("x", "failed"), ("y", "warning")], "input_path string, status string")
    assert plan_of(validate.batch(checks)).count("Relation [") == 1
    got = validate.batch(checks, issues).first()
    assert tuple(got)[:4] == (5, 1, 3, 2) and [tuple(x) for x in got.failed_checks] == [("a", 1), ("b", 2)]
    empty = validate.batch(checks.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, [])

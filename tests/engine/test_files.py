"""Inputs, registries and stored documents: what is wrong with them is told, never guessed."""

import json
import shutil

import pytest
import yaml
from pyspark.sql import functions as F

from blockloom import api
from blockloom.functions import text as t
from blockloom.operators import blocks as B
from blockloom.operators import render, strict, validate
from blockloom.operators import requirements as R
from blockloom.sources import adapters, sinks
from blockloom.sources import rules as S
from blockloom.streaming import folder  # noqa: F401  imports the reader

RULES = {"Normal": {"block_type": "paragraph", "default_zone": "main_body"}, "Odd": {"block_type": "paragraph", "own": 1}}
REGISTRY = {"template_id": "T", "version": "1", "settings": {"classification_mode": "style_first"}, "document_zones": ["main_body"], "block_types": ["paragraph"], "style_registry": RULES}


def analysed(spark):
    rows = [(d, i, "paragraph", s, x) for d in (1, 2) for i, (s, x) in enumerate([("Heading 1", "1 Part"), ("Normal", "text"), ("List dash", "- item"), ("Body X", "more")], 1)]
    blocks = spark.createDataFrame(rows, "document_id long, block_order long, kind string, style string, text string")
    return B.analysed(blocks, S.style_rules(spark, S.LINE_STYLES), S.ENGLISH)


@pytest.fixture(scope="module")
def base(spark):
    return analysed(spark).cache()


def test_inputs_of_folders(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    content = sinks.word_file(["first line", "second line"])
    for name in ("in/a.docx", "in/deep/b.DOCX", "c.docx"):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "in/note.txt").write_text("x")
    one = str(tmp_path / "c.docx")
    inputs = [str(tmp_path / "in"), one, f"file://{one}", str(tmp_path / "in" / "a.docx"), str(tmp_path / "none.docx"), str(tmp_path / "none.docx")]
    good, issues = validate.discover(validate.list_inputs(spark, inputs))
    assert sorted(r.path.rsplit("/")[-1] for r in good.collect()) == ["a.docx", "b.DOCX", "c.docx"]
    assert sorted((r.input_path.rsplit("/")[-1], r.status) for r in issues.collect()) == [("none.docx", "failed"), ("note.txt", "warning")]
    (tmp_path / "styles.yaml").write_text(yaml.safe_dump(REGISTRY))
    checks, batch = api.validate_inputs(spark, inputs, str(tmp_path / "styles.yaml"))
    row = batch.first()
    assert (row.total_documents, row.passed_documents, row.failed_documents, row.warnings) == (5, 3, 1, 1) and row.failed_checks == []
    assert checks.select("document_id").distinct().count() == 3
    shutil.rmtree(tmp_path / "in")
    assert api.validate_inputs(spark, [str(tmp_path / "in" / "a.docx")])[1].first().failed_documents == 1


def test_strict_registry(spark, tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text(yaml.safe_dump(REGISTRY))
    assert [r[0] for r in api.read_registry(spark, str(path))] == ["Normal", "Odd"] and api.read_registry(spark, str(path))[1][3] == "unknown_zone"
    wrong = {**REGISTRY, "colour": 1, "settings": {"keep_unknown_styles": "yes", "mode": 1}, "style_registry": {"A": {"default_zone": 3}, "B": []}, "zone_detection_rules": [{"name": "x", "assign_zone": "toc", "extra": 1}]}
    del wrong["version"]
    found = {(r.path, r.problem.split(":")[0]) for r in strict.registry_problems(spark, wrong).collect()}
    assert found == {
        ("colour", "unknown key"), ("version", "missing key"), ("settings.keep_unknown_styles", "wrong type"), ("settings.mode", "unknown key"), ("style_registry.A.default_zone", "wrong type"),
        ("style_registry.A.block_type", "missing key"), ("style_registry.B", "wrong type"), ("zone_detection_rules[0].extra", "unknown key"),
    }
    path.write_text(yaml.safe_dump(wrong))
    with pytest.raises(ValueError, match="colour: unknown key"):
        api.read_registry(spark, str(path))
    path.write_text("- just a list")
    with pytest.raises(ValueError, match="mapping"):
        api.read_registry(spark, str(path))


def test_whole_documents_are_strict_and_complete(spark, base, tmp_path):
    texts = render.whole_document_json(base, "T")
    named = texts.select(F.col("document_id").cast("string").alias("name"), "json")
    rows, found = strict.read_documents(named)
    assert found.count() == 0 and rows.count() == 8
    part = render.read_document_parts(texts).orderBy("document_id").first()
    assert (part.path, part.template_id, part.total_blocks, part.total_list_items, part.styles) == ("1", "T", 4, 1, ["Body X", "Heading 1", "List dash", "Normal"])
    sinks.write_whole_documents(base, str(tmp_path / "whole"), "T")
    stored = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "whole")).collect()]
    assert sorted(x["document_id"] for x in stored) == [1, 2] and stored[0]["blocks"][0]["block_id"] == "b000001" and list(stored[0]) == ["document_id", "source", "summary", "styles", "blocks"]
    plan = render.whole_document_json(analysed(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    broken = spark.createDataFrame([("x", "[1]"), ("y", None), ("z", '{"document_id": 1, "blocks": {"a": 1}}'), ("w", '{"document_id": 1, "blocks": [3]}')], "name string, json string")
    assert {(r.name, r.path) for r in strict.problems(broken, strict.DOCUMENT).collect()} == {("x", ""), ("y", ""), ("z", "blocks"), ("z", "blocks.a"), ("w", "blocks[0]")}


def test_payload(spark, base):
    found = sinks.payload(base.select("document_id", "block_order", "block_id", "norm"), "blocks", ["block_order"]).orderBy("document_id").first()
    assert json.loads(found.json) == {"document_id": 1, "total_blocks": 4, "blocks": [{"block_order": i, "block_id": f"b{i:06d}", "norm": x} for i, x in enumerate(["1 Part", "text", "- item", "more"], 1)]}


def test_own_check_in_the_same_pass(spark, base):
    own = validate.Check("short", "No block is short.", "Some blocks are short.", lambda b: F.length("norm") < 5)
    found = {(r.document_id, r.name): (r.issues, r.offending, r.message) for r in validate.run_checks(base, checks=[*validate.CHECKS, own]).collect()}
    assert found[1, "short"] == (2, ["b000002", "b000004"], "Some blocks are short.") and found[2, "non_empty_document"][0] == 0
    failing = validate.batch(validate.run_checks(base, checks=[own])).first().failed_checks
    assert [tuple(x) for x in failing] == [("short", 2)]


def test_list_formatting_of_blocks(spark, base):
    found = [r.list_formatting for r in api.with_list_formatting(base).orderBy("document_id", "block_order").collect()]
    assert [f is None for f in found] == [True, True, False, True] * 2 and (found[2].list_id, found[2].marker_text, found[2].numbering_style, found[2].level) == ("b000003", "-", "bullet", 1)


def test_folding(spark):
    words = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁn", "FIN", "İ", "K"]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select(t.folded(F.col("w")).alias("f")).collect()]
    assert got == [w.casefold() for w in words]
    assert spark.range(1).select(B.Shapes(S.Lexicon(**{**S.ENGLISH.__dict__, "title_styles": ["strasse"]})).has(F.lit("Hauptstraße"), ["strasse"]).alias("x")).first().x


def test_line_blocks_keep_their_order(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    assert [r.block_order for r in adapters.deep_blocks(docs).orderBy("block_order").collect()] == [1, 2, 3]


def test_baseline_decisions_as_columns(spark):
    """The baseline reviewer in one pass gives what joining its decisions gives."""
    words = "records that stay with staff when asked; or kept by hand. They go from here with care. Items that end by noon:"
    docs = spark.createDataFrame([(i, "\n".join(words[k * (i + 3) % 60 :] for k in range(48))) for i in range(6)], "doc_id long, text string")
    base = B.analysed(adapters.line_blocks(docs), S.style_rules(spark, S.LINE_STYLES), S.ENGLISH)
    found = R.records(R.candidates(base, S.ENGLISH), S.ENGLISH).cache()
    own, joined = R.apply_baseline(found, S.ENGLISH), R.apply_decisions(found, R.decisions(R.review_cases(found), found), S.ENGLISH)
    assert joined[1].count() > 10
    for a, b in zip(own, joined, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    found.unpersist()
    plan = R.apply_baseline(R.records(R.candidates(base, S.ENGLISH), S.ENGLISH), S.ENGLISH)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan

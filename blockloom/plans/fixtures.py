"""Queries over small fixtures with stated results: rules of the Russian template, damaged documents, review lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import render, validate
from ..operators import requirements as R
from ..sources import rules as S

#: Styles of the fixture's rule table.
STYLES = [
    ("Заголовок 1", "heading", "main_heading", "main_body", 1, None, None, []),
    ("Основной текст", "paragraph", "main_text", "main_body", None, None, None, []),
    ("Перечень", "list_item", "bulleted_dash", "main_body", None, "bulleted_dash", 1, []),
    ("Титульный", "title_meta", "title_page_meta", "title_page", None, None, None, ["is_front_matter"]),
    ("05_ИЦЖТ_Примечание_слово", "note_like", "note_label", "main_body", None, None, None, []),
    ("05_ИЦЖТ_Примечание_текст после", "note_like", "note_text", "main_body", None, None, None, []),
]
#: Document, style, text, and the zone, type and number that the rules give.
RUSSIAN_ROWS = [
    (1, "Титульный лист", "Руководство", "title_page", "paragraph", None),
    (1, "Заголовок титульный", "Система качества", "title_page", "heading", None),
    (1, "Структурный (вне содержания)", "Контрольный лист документа", "control_sheet", "paragraph", None),
    (1, "Оглавление 1", "1 Общие положения", "toc", "heading", "1"),
    (1, "Заголовок 1", "1 Общие положения", "main_body", "heading", "1"),
    (1, "Титульный лист", "Текст не на титуле.", "main_body", "paragraph", None),
    (1, "Основной текст", "Исполнитель должен вести журнал.", "main_body", "paragraph", None),
    (1, "Заголовок титульный", "Раздел", "main_body", "heading", None),
    (1, "Заголовок 1", "Приложение А (обязательное) Формы", "appendix", "appendix_heading", "А"),
    (1, "Титульный лист", "Текст приложения.", "appendix", "paragraph", None),
    (1, "Основной текст", "А.1 Форма журнала", "appendix", "appendix_heading", "А.1"),
    (1, "Основной текст", "Библиография", "bibliography", "paragraph", None),
    (1, "Основной текст", "ГОСТ 1, часть 2.", "bibliography", "paragraph", None),
    (2, "Титульный", "Руководство", "title_page", "title_meta", None),
    (2, "Структурный", "Контрольный лист документа", "main_body", "paragraph", None),
    (2, "Основной текст", "Контрольный лист", "control_sheet", "paragraph", None),
    (2, "Основной текст", "Лист согласования.", "control_sheet", "paragraph", None),
    (2, "Основной текст", "Содержание", "toc", "paragraph", None),
    (2, "Заголовок 1", "2 Порядок", "main_body", "heading", "2"),
    (2, "Перечень", "- первое", "main_body", "list_item", None),
    (2, "05_ИЦЖТ_Примечание_слово", "Примечание", "main_body", "note_label", None),
    (2, "05_ИЦЖТ_Примечание_текст после", "Пояснение.", "main_body", "note_text", None),
]


def values(rows: list[tuple], names: str) -> str:
    """Stated rows as SQL."""
    show = lambda x: "NULL" if x is None else repr(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


def _russian(spark: SparkSession) -> DataFrame:
    rows, at = [], {}
    for doc, style, text, *_ in RUSSIAN_ROWS:
        at[doc] = at.get(doc, 0) + 1
        rows.append((doc, at[doc], "paragraph", style, text))
    blocks = spark.createDataFrame(rows, "document_id long, block_order long, kind string, style string, text string")
    return B.analysed(blocks, S.style_rules(spark, STYLES), S.RUSSIAN)


def russian_zones(spark: SparkSession) -> DataFrame:
    """Zones by styles of the title page and the control sheet, and by anchors."""
    return _russian(spark).select("document_id", "norm", "zone", "block_type")


ZONES = values([(d, t, z, k) for d, _, t, z, k, _ in RUSSIAN_ROWS], "document_id, norm, zone, block_type")
ZONES = ZONES.replace("SELECT *", "SELECT CAST(document_id AS BIGINT) AS document_id, norm, zone, block_type", 1)


def russian_blocks(spark: SparkSession) -> DataFrame:
    return _russian(spark).filter("heading_number IS NOT NULL OR note_group IS NOT NULL").select("document_id", "norm", "heading_number", "note_group")


_NOTED = [(d, t, n, "note_group_0001" if k.startswith("note") else None) for d, _, t, _, k, n in RUSSIAN_ROWS if n or k.startswith("note")]
BLOCKS = values(_NOTED, "document_id, norm, heading_number, note_group").replace("SELECT *", "SELECT CAST(document_id AS BIGINT) AS document_id, norm, heading_number, note_group", 1)

#: Blocks of a stored document with one fault for each check: order, id, type, zone, section, path, links, features.
DAMAGED_ROWS = [
    (1, 1, "b1", "heading", "main_body", None, [], None, "b2", False, [], None, None),
    (1, 2, "b2", "paragraph", "main_body", "1", ["2"], "b1", "b3", False, [], None, None),
    (1, 3, "b3", "table", "main_body", "1", ["1"], "b2", "b4", False, [], 2, None),
    (1, 4, "b4", "table", "main_body", "1", ["1"], "b3", "b5", False, [], None, None),
    (1, 5, "b5", "note_like", "main_body", "1", ["1"], "b4", "b9", None, [], None, None),
    (1, 6, "b6", "riddle", "main_body", "1", ["1"], "b5", "b7", False, [], None, None),
    (1, 7, "b7", "paragraph", "nowhere", "1", ["1"], "b6", None, False, [], None, None),
    (2, 1, "b1", "paragraph", "main_body", None, [], None, "b2", False, [], None, None),
    (2, 2, "b2", "table", "main_body", None, [], "b1", None, False, [], 1, 1),
]
DAMAGED_SCHEMA = "document_id long, block_order long, block_id string, block_type string, zone string, section_id string, section_path array<string>, prev_id string, next_id string, list_follows boolean, reasons array<string>, table_rows long, table_cols long"
#: What is wrong: document, check, number, ids.
FAULTS = {
    (1, "structure_summary_consistency"): (2, "total_blocks,total_figures"), (1, "enum_domain_validity"): (2, "b6,b7"), (1, "adjacent_block_links"): (1, "b5"), (1, "table_block_payloads"): (2, "b3,b4"),
    (1, "note_block_review_readiness"): (1, "b5"), (1, "section_context_validity"): (2, "b1,b2"), (1, "review_candidates_links"): (1, "rc_2"), (3, "non_empty_document"): (1, ""),
}


def damaged_checks(spark: SparkSession) -> DataFrame:
    """Every check on stored documents: one with each fault, one without any, one without blocks."""
    base = spark.createDataFrame(DAMAGED_ROWS, DAMAGED_SCHEMA)
    documents = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    candidates = spark.createDataFrame([(1, "rc_1", "b1"), (1, "rc_2", "b8"), (2, "rc_1", "b2")], "document_id long, candidate_id string, block_id string")
    counters = ["total_blocks", *B.COUNTED, "total_notes"]
    stated = {1: {"total_blocks": 8, "total_tables": 2, "total_sections": 1, "total_figures": 1, "total_notes": 1}, 2: {"total_blocks": 2, "total_tables": 1}, 3: {}}
    summary = spark.createDataFrame([(d, *[x.get(c, 0) for c in counters]) for d, x in stated.items()], "document_id long, " + ", ".join(f"{c} long" for c in counters))
    found = validate.run_checks(base, documents, candidates, summary)
    return found.withColumn("offending", F.array_join("offending", ","))


def _damaged() -> str:
    rows = []
    for doc in (1, 2, 3):
        for name, (good, bad) in validate.MESSAGES.items():
            n, ids = FAULTS.get((doc, name), (0, ""))
            rows.append((doc, name, "failed" if n else "passed", n, bad if n else good, ids))
    return values(rows, "document_id, name, status, issues, message, offending").replace("SELECT *", "SELECT CAST(document_id AS BIGINT) AS document_id, name, status, CAST(issues AS BIGINT) AS issues, message, offending", 1)


DAMAGED = _damaged()


def default_decision(spark: SparkSession) -> DataFrame:
    """The decision on a kind of ambiguity that has no policy."""
    cases = spark.createDataFrame([(1, 1, "reqv_0001", "reqr_0001", "unheard_of", "single_atomic")], "document_id long, case_no long, case_id string, requirement_id string, ambiguity string, strategy string")
    found = spark.createDataFrame([(1, "reqr_0001", [("a1",)])], "document_id long, requirement_id string, atomics array<struct<atomic_id:string>>")
    return R.decisions(cases, found).select("document_id", "decision_id", "label", "action", "confidence")


DEFAULT = "SELECT CAST(1 AS BIGINT) AS document_id, 'reqd_0001' AS decision_id, 'review_recommended' AS label, CAST(NULL AS VARCHAR) AS action, CAST(0.75 AS DOUBLE) AS confidence"

#: Blocks to render and the lines that they give: hints and body.
RENDERED = [
    ("heading", "Общее", [], None, None, None, None, None, "Общее"),
    ("paragraph", "", ["is_empty"], None, None, None, None, "[REVIEW] flag:is_empty", "[NO TEXT]"),
    ("empty", "", ["is_empty"], None, None, None, None, None, "[EMPTY BLOCK]"),
    ("unknown", "нечто", ["needs_review", "is_suspicious"], None, None, None, None, "[REVIEW] needs_review | suspicious | unresolved", "[UNKNOWN BLOCK] нечто"),
    ("note_text", "Текст", [], True, None, None, None, "[REVIEW] unresolved", "Текст"),
    ("list_item", "первое", [], None, None, None, 2, None, "    - первое"),
    ("table", "", [], None, None, None, None, None, "[TABLE BLOCK WITHOUT TABLE_INFO]"),
    ("table", "", [], None, 0, 0, None, None, "table_id=- | rows=0 | cols=0 | style=Стиль | header_row=False\n[EMPTY TABLE]"),
    ("table", "", [], None, 2, 2, None, None, "table_id=- | rows=2 | cols=2 | style=Стиль | header_row=True\na\tb\nc\t"),
]


def review_lines(spark: SparkSession) -> DataFrame:
    """Hints and bodies of every kind of block in the review document."""
    rows = [
        (1, i, f"b{i}", kind, "main_body", ["1"], "Стиль", text, flags, orphan, n, m, [["a", "b"], ["c", None]] if n else None, depth)
        for i, (kind, text, flags, orphan, n, m, depth, *_) in enumerate(RENDERED, 1)
    ]
    schema = "document_id long, block_order long, block_id string, block_type string, zone string, section_path array<string>, style string, norm string, flags array<string>, is_orphan boolean, table_rows long, table_cols long, cells array<array<string>>, list_level int"
    return render.render_rows(spark.createDataFrame(rows, schema)).select("block_order", "hint", "body")


LINES = values([(i, r[-2], r[-1]) for i, r in enumerate(RENDERED, 1)], "block_order, hint, body").replace("SELECT *", "SELECT CAST(block_order AS BIGINT) AS block_order, hint, body", 1)

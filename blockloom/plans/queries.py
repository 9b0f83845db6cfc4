"""The engine's queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import text as t
from ..operators import blocks as B
from ..operators import render, strict, tables, validate
from ..operators import requirements as R
from ..sources import adapters as A
from ..sources import rules as S
from . import fixtures
from . import oracles as O
from .catalog import register


def _lines(spark: SparkSession, d: str) -> DataFrame:
    documents = A.read_table(spark, d, "documents")
    return A.by_document(A.line_blocks(documents), documents)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = A.read_table(spark, d, "pages")
    return A.by_document(A.page_blocks(pages), pages)


def _line_base(spark: SparkSession, d: str) -> DataFrame:
    return B.analysed(_lines(spark, d), S.style_rules(spark, S.LINE_STYLES), S.ENGLISH)


def _page_base(spark: SparkSession, d: str) -> DataFrame:
    return B.analysed(_pages(spark, d), S.style_rules(spark, S.TAG_STYLES), S.ENGLISH)


def _deep_base(spark: SparkSession, d: str) -> DataFrame:
    documents = A.read_table(spark, d, "documents")
    return B.classified(A.by_document(A.deep_blocks(documents), documents), S.style_rules(spark, S.DEEP_STYLES), S.ENGLISH)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.records(R.candidates(_line_base(spark, d), S.ENGLISH), S.ENGLISH)


def _applied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = _records(spark, d)
    return (records, *R.apply_baseline(records, S.ENGLISH))


def _path(name: str = "section_path") -> Column:
    return F.array_join(name, "/").alias("path")


def _csv(name: str, alias: str | None = None) -> Column:
    return F.array_join(name, ",").alias(alias or name)


PATH = "array_to_string(path, '/') AS path"

register("q_blocks_pages", _pages, O.composed(O.pages_sql(), "SELECT document_id, block_order, kind, style, text FROM blocks"))
register("q_blocks_docs", _lines, O.composed(O.lines_sql(), "SELECT * FROM blocks"))
register(
    "q_blocks_chat", lambda s, d: A.chat_blocks(A.read_table(s, d, "conversations")),
    "SELECT conv_id AS document_id, CAST(turn + 1 AS BIGINT) AS block_order, 'paragraph' AS kind, role AS style, text FROM conversations",
)
register(
    "q_normalize_text",
    lambda s, d: A.read_table(s, d, "documents").select("doc_id", t.block_text(F.col("text")).alias("block_text"), t.collapsed(F.col("text")).alias("one_line"), t.requirement_text(F.col("text")).alias("requirement"), t.preview(F.col("text")).alias("preview")),
    "SELECT doc_id, " + O.block_text("text") + r" AS block_text, trim(regexp_replace(text, '[\s ]+', ' ', 'g')) AS one_line, "
    + O.strip(r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[\s ]+', ' ', 'g')), '^(?:[-•–]|[0-9]+[.)]|[A-Za-zА-Яа-я]\))\s+', ''), '\s+([:;,.])', '\1', 'g'), '[:;]$', '')")
    + " AS requirement, nullif(substr(" + O.strip("text") + ", 1, 120), '') AS preview FROM documents",
)
register(
    "q_style_join", lambda s, d: _pages(s, d).join(F.broadcast(S.style_rules(s, S.TAG_STYLES)), "style", "left").select("document_id", "block_order", "style", "rule_type", "rule_zone", _csv("rule_flags", "flags")),
    O.composed({**O.pages_sql(), "rules": O.rules_sql(S.TAG_STYLES)}, "SELECT document_id, block_order, style, rt AS rule_type, rz AS rule_zone, rflags AS flags FROM blocks LEFT JOIN rules USING (style)"),
)
register(
    "q_rule_miss", lambda s, d: _pages(s, d).join(F.broadcast(S.style_rules(s, S.TAG_STYLES)), "style", "left_anti").select("document_id", "block_order", "style"),
    O.composed({**O.pages_sql(), "rules": O.rules_sql(S.TAG_STYLES)}, "SELECT document_id, block_order, style FROM blocks ANTI JOIN rules USING (style)"),
)
register(
    "q_heading_parts", lambda s, d: _line_base(s, d).filter("heading_title IS NOT NULL").select("document_id", "block_order", "heading_number", "heading_title", F.col("heading_level").cast("long").alias("heading_level"), "method", "confidence"),
    O.lines("SELECT document_id, block_order, number AS heading_number, title AS heading_title, CAST(hl AS BIGINT) AS heading_level, method, CASE WHEN rt IS NOT NULL THEN CAST(0.99 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS confidence FROM r2 WHERE hd"),
)
register(
    "q_heading_shape", lambda s, d: _line_base(s, d).filter("norm <> ''").select("document_id", "block_order", B.Shapes(S.ENGLISH).heading_shape(F.col("norm")).alias("shape"), t.word_total(F.col("norm")).cast("long").alias("words")),
    O.lines("SELECT document_id, block_order, shape, CAST(nw AS BIGINT) AS words FROM r2 WHERE norm <> ''"),
)
register(
    "q_list_items", lambda s, d: _line_base(s, d).filter("block_type = 'list_item'").select("document_id", "block_order", "list_type", "list_mark", F.col("rule_list_level").cast("long").alias("list_level")),
    O.lines(r"SELECT document_id, block_order, 'bulleted' AS list_type, nullif(regexp_extract(norm, '^\s*([-•–])\s+', 1), '') AS list_mark, CAST(1 AS BIGINT) AS list_level FROM r2 WHERE bt = 'list_item'"),
)
CLASSES = "SELECT document_id, block_order, bt AS block_type, subtype AS block_subtype, zone, flags, norm FROM r2"
_classes = lambda b: b.select("document_id", "block_order", "block_type", "block_subtype", "zone", _csv("flags"), "norm")
register("q_classify", lambda s, d: _classes(_line_base(s, d)), O.lines(CLASSES))
register("q_classify_pages", lambda s, d: _classes(_page_base(s, d)), O.pages(CLASSES))
register(
    "q_zone_state", lambda s, d: _line_base(s, d).select("document_id", "block_order", "zone_before", "zone_after", F.col("power").cast("long").alias("power")),
    O.lines("SELECT document_id, block_order, zb AS zone_before, za AS zone_after, CAST(power AS BIGINT) AS power FROM r2"),
)
register(
    "q_section_path", lambda s, d: _line_base(s, d).select("document_id", "block_order", _path(), "compact_path", "section_id", "section_title", F.col("section_level").cast("long").alias("section_level"), "parent_section"),
    O.lines(f"SELECT document_id, block_order, {PATH}, nullif(array_to_string(path, ' > '), '') AS compact_path, sid AS section_id, stitle AS section_title, CAST(slevel AS BIGINT) AS section_level, parent AS parent_section FROM r2"),
)
register(
    "q_zone_scan", lambda s, d: _deep_base(s, d).select("document_id", "block_order", "block_type", "zone", "zone_before", "zone_after"),
    O.deep("SELECT document_id, block_order, bt AS block_type, zone, zb AS zone_before, za AS zone_after FROM b14"),
)
register(
    "q_deep_sections", lambda s, d: _deep_base(s, d).select("document_id", "block_order", "zone", _path(), "section_title", F.col("section_level").cast("long").alias("section_level"), "parent_section"),
    # A heading is open at a block that follows in its zone until a heading of its level or above comes there.
    O.composed(
        {
            **O.analysis_sql(O.deep_sql(), S.DEEP_STYLES),
            "heads": "SELECT document_id, block_order AS at, zone, lvl, ttl, CASE WHEN om THEN idm ELSE ida END AS id FROM b15 WHERE om OR oa",
            "closed": """SELECT h.*, coalesce((SELECT min(n.at) FROM heads n WHERE n.document_id = h.document_id AND n.zone = h.zone AND n.at > h.at AND n.lvl <= h.lvl), 1000000000) AS till FROM heads h""",
        },
        """SELECT b.document_id, b.block_order, b.zone, coalesce(string_agg(h.id, '/' ORDER BY h.at), '') AS path, arg_max(h.ttl, h.at) AS section_title, CAST(arg_max(h.lvl, h.at) AS BIGINT) AS section_level,
            list(h.id ORDER BY h.at)[-2] AS parent_section FROM b15 b LEFT JOIN closed h ON h.document_id = b.document_id AND h.zone = b.zone AND h.at <= b.block_order AND b.block_order < h.till GROUP BY ALL""",
    ),
)
register(
    "q_links",
    lambda s, d: A.chat_blocks(A.read_table(s, d, "conversations")).withColumn("block_id", F.format_string("b%06d", F.col("block_order"))).select("document_id", "block_id", F.lag("block_id").over(B.in_order()).alias("prev_id"), F.lead("block_id").over(B.in_order()).alias("next_id")),
    "SELECT document_id, bid AS block_id, lag(bid) OVER w AS prev_id, lead(bid) OVER w AS next_id FROM (SELECT conv_id AS document_id, turn, printf('b%06d', turn + 1) AS bid FROM conversations) WINDOW w AS (PARTITION BY document_id ORDER BY turn)",
)
register(
    "q_review_features", lambda s, d: _line_base(s, d).select("document_id", "block_id", "prev_id", "next_id", "source", "ends_with_colon", "like_table", "like_figure", "like_appendix", "like_note", "artifact", "list_follows"),
    O.lines("SELECT document_id, bid AS block_id, pid AS prev_id, nid AS next_id, source, colon AS ends_with_colon, ltab AS like_table, lfig AS like_figure, lapp AS like_appendix, lnote AS like_note, artifact, lf AS list_follows FROM r2"),
)
register(
    "q_next_nonempty_is_list", lambda s, d: _line_base(s, d).filter("list_follows").groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks")),
    O.lines("SELECT bt AS block_type, count(*) AS blocks FROM r2 WHERE lf GROUP BY 1"),
)


def _slices(s: SparkSession, d: str) -> DataFrame:
    near = B.in_order()
    join = lambda a, b: F.array_join(F.collect_list(t.preview(F.col("text"))).over(near.rowsBetween(a, b)), "|")
    return A.chat_blocks(A.read_table(s, d, "conversations")).select("document_id", "block_order", join(-2, -1).alias("before"), join(1, 2).alias("after"))


register(
    "q_context_slices", _slices,
    f"""SELECT document_id, block_order, coalesce(string_agg(p, '|') OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(p, '|') OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after
        FROM (SELECT conv_id AS document_id, CAST(turn + 1 AS BIGINT) AS block_order, nullif(substr({O.strip("text")}, 1, 120), '') AS p FROM conversations)""",
)
register(
    "q_related_pair_artifact", lambda s, d: _line_base(s, d).filter("array_contains(reasons, 'layout_artifact_between_related_blocks')").select("document_id", "block_id", "prev_type", "next_type"),
    O.lines("SELECT document_id, bid AS block_id, pt AS prev_type, nt AS next_type FROM r2 WHERE list_contains(reasons, 'layout_artifact_between_related_blocks')"),
)
register(
    "q_note_pairs", lambda s, d: _line_base(s, d).filter("note_role IS NOT NULL").select("document_id", "block_id", "block_type", "note_group", "is_orphan", "note_role"),
    O.lines("SELECT document_id, bid AS block_id, bt AS block_type, grp AS note_group, orphan AS is_orphan, role AS note_role FROM r2 WHERE role IS NOT NULL"),
)
register(
    "q_review_reasons", lambda s, d: _line_base(s, d).select("document_id", "block_id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("blocks")),
    O.lines("SELECT reason, count(*) AS blocks FROM (SELECT unnest(reasons) AS reason FROM r2) GROUP BY 1"),
)
register(
    "q_review_candidates",
    lambda s, d: B.review_candidates(_line_base(s, d)).select("document_id", "candidate_id", "block_id", "label", "block_type", _csv("reasons"), F.array_join(F.transform("before", lambda x: x["block_id"]), ",").alias("before_ids"), F.array_join(F.transform("after", lambda x: x["block_id"]), ",").alias("after_ids"), "compact_path", "source"),
    O.lines("""SELECT document_id, printf('rc_%04d', row_number() OVER (PARTITION BY document_id ORDER BY block_order)) AS candidate_id, block_id, label, block_type, reasons, before_ids, after_ids, compact_path, source FROM (
        SELECT document_id, block_order, bid AS block_id, coalesce(subtype, bt) AS label, bt AS block_type, array_to_string(reasons, ',') AS reasons, len(reasons) AS nr, nullif(array_to_string(path, ' > '), '') AS compact_path, source,
            coalesce(string_agg(bid, ',') OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before_ids,
            coalesce(string_agg(bid, ',') OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after_ids FROM r2) WHERE nr > 0"""),
)
SUMMARY = """SELECT document_id, count(*) AS total_blocks, count(*) FILTER (bt = 'table') AS total_tables, count(*) FILTER (bt = 'list_item') AS total_list_items, count(*) FILTER (bt = 'template_instruction') AS total_template_instructions,
    count(*) FILTER (bt = 'heading') AS total_sections, count(*) FILTER (bt = 'appendix_heading') AS total_appendix_sections, count(*) FILTER (bt = 'figure') AS total_figures, count(*) FILTER (bt = 'formula') AS total_formulas,
    count(DISTINCT grp) + count(*) FILTER (bt IN ('note_label', 'note_text') AND grp IS NULL) + count(*) FILTER (bt = 'note_like') AS total_notes FROM r2 GROUP BY 1"""
register("q_structure_summary", lambda s, d: B.structure_summary(_line_base(s, d)), O.lines(SUMMARY))
register("q_structure_summary_pages", lambda s, d: B.structure_summary(_page_base(s, d)), O.pages(SUMMARY))
register(
    "q_used_styles", lambda s, d: B.used_styles(_lines(s, d)).select("document_id", _csv("styles")),
    O.composed(O.lines_sql(), f"SELECT document_id, coalesce(string_agg(DISTINCT st, ',' ORDER BY st), '') AS styles FROM (SELECT document_id, nullif({O.strip("coalesce(style, '')")}, '') AS st FROM blocks) GROUP BY 1"),
)

CELLS = {
    "cells": """SELECT document_id, "row", unnest([0, 1, 2, 3]) AS col, unnest([l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR)]) AS text
        FROM (SELECT *, l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS "row" FROM lineitem)""",
    "marked": """SELECT *, CASE WHEN text IS NOT DISTINCT FROM lag(text) OVER w AND lag("row") OVER w = "row" - 1 THEN 0 ELSE 1 END AS brk FROM cells WINDOW w AS (PARTITION BY document_id, col ORDER BY "row")""",
    "keyed": """SELECT *, col || ':' || sum(brk) OVER (PARTITION BY document_id, col ORDER BY "row") AS cell_key FROM marked""",
    "spans": """SELECT document_id, cell_key, min("row") AS "row", CAST(min(col) AS BIGINT) AS col, max("row") - min("row") + 1 AS row_span, CAST(max(col) - min(col) + 1 AS BIGINT) AS col_span, arg_min(text, "row") AS text FROM keyed GROUP BY ALL""",
}


def _cells(s: SparkSession, d: str) -> DataFrame:
    return tables.with_keys(A.order_cells(A.read_table(s, d, "lineitem")))


register("q_cell_spans", lambda s, d: tables.spans(_cells(s, d)), O.composed(CELLS, "SELECT * FROM spans"))
register(
    "q_table_grid",
    lambda s, d: tables.grid(_cells(s, d)).select("document_id", F.col("rows_count").cast("long").alias("rows_count"), F.col("cols_count").cast("long").alias("cols_count"), F.col("header_rows").cast("long").alias("header_rows"), F.array_join(F.transform("cells", lambda r: F.array_join(r, ",")), ";").alias("cells")),
    O.composed(CELLS, """SELECT document_id, count(*) AS rows_count, CAST(4 AS BIGINT) AS cols_count, CAST(1 AS BIGINT) AS header_rows, string_agg(r, ';' ORDER BY "row") AS cells
        FROM (SELECT document_id, "row", string_agg(text, ',' ORDER BY col) AS r FROM cells GROUP BY ALL) GROUP BY 1"""),
)
register(
    "q_grid_cells", lambda s, d: tables.grid_cells(_cells(s, d)),
    O.composed(CELLS, """SELECT document_id, "row", CAST(col AS BIGINT) AS col, text, CASE WHEN "row" = min("row") OVER k THEN max("row") OVER k - min("row") OVER k + 1 END AS row_span,
        CAST(CASE WHEN "row" = min("row") OVER k THEN 1 END AS BIGINT) AS col_span FROM keyed WINDOW k AS (PARTITION BY document_id, cell_key)"""),
)
WRITTEN = {
    "numbered": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS "row" FROM lineitem""",
    "written": """SELECT document_id, "row", generate_subscripts(cs, 1) - 1 AS place, unnest(cs).t AS text, unnest(cs).w AS span FROM (SELECT l_orderkey AS document_id, "row", list_filter([
        {'t': l_returnflag, 'w': 1 + l_orderkey % 2}, {'t': l_linestatus, 'w': 1 + ("row" // 4) % 2}, {'t': CASE WHEN "row" % 3 <> 0 THEN CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) END, 'w': 1}, {'t': CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR), 'w': 1 + l_linenumber % 2}], lambda c: c.t IS NOT NULL) AS cs FROM numbered)""",
    "placed": """SELECT *, coalesce(lag(text) OVER (PARTITION BY document_id, place ORDER BY "row") = text, false) AS goes_on,
        CAST(coalesce(sum(span) OVER (PARTITION BY document_id, "row" ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM written""",
    "positions": """SELECT *, unnest(range(start, start + span)) AS col FROM placed""",
    # A position's own cell lies in the last row up to it that does not go on, or that has nothing above.
    "tops": """SELECT p.document_id, p."row", p.col, max(q."row") AS top FROM positions p JOIN (
        SELECT a.* FROM positions a LEFT JOIN positions b ON b.document_id = a.document_id AND b.col = a.col AND b."row" = a."row" - 1 WHERE NOT a.goes_on OR b."row" IS NULL
        ) q ON q.document_id = p.document_id AND q.col = p.col AND q."row" <= p."row" GROUP BY ALL""",
    "marked_cells": """SELECT t.document_id, t."row", t.col, o."row" || ':' || o.start AS cell_key, o.text FROM tops t JOIN positions o ON o.document_id = t.document_id AND o."row" = t.top AND o.col = t.col""",
    "boxes": """SELECT document_id, cell_key, min("row") AS "row", min(col) AS col, max("row") - min("row") + 1 AS row_span, max(col) - min(col) + 1 AS col_span, arg_min(text, "row" * 1000 + col) AS text FROM marked_cells GROUP BY ALL""",
}


def _written(s: SparkSession, d: str) -> DataFrame:
    return tables.laid_out(A.order_written_rows(A.read_table(s, d, "lineitem")))


register("q_merged_cells", lambda s, d: tables.spans(_written(s, d)), O.composed(WRITTEN, "SELECT * FROM boxes"))
register(
    "q_merged_grid",
    lambda s, d: tables.grid(_written(s, d)).select("document_id", F.col("rows_count").cast("long").alias("rows_count"), F.col("cols_count").cast("long").alias("cols_count"), F.array_join(F.transform("cells", lambda r: F.array_join(r, ",", "-")), ";").alias("cells")),
    O.composed(WRITTEN, """SELECT document_id, count(*) AS rows_count, any_value(n) AS cols_count, string_agg(r || repeat(',-', CAST(n - m AS INTEGER)), ';' ORDER BY "row") AS cells FROM (
        SELECT document_id, "row", string_agg(text, ',' ORDER BY col) AS r, count(*) AS m, max(count(*)) OVER (PARTITION BY document_id) AS n FROM marked_cells GROUP BY document_id, "row") GROUP BY 1"""),
)
register(
    "q_merged_positions", lambda s, d: tables.grid_cells(_written(s, d)),
    O.composed(WRITTEN, """SELECT m.document_id, m."row", m.col, m.text, b.row_span, b.col_span FROM marked_cells m LEFT JOIN boxes b ON b.document_id = m.document_id AND b.cell_key = m.cell_key AND b."row" = m."row" AND b.col = m.col"""),
)
register(
    "q_requirement_candidates", lambda s, d: R.candidates(_line_base(s, d), S.ENGLISH).select("document_id", "candidate_id", "block_id", _path(), "zone", "candidate_text", "reason", "confidence", "kind"),
    O.requirements(f"SELECT document_id, printf('reqc_%04d', n) AS candidate_id, bid AS block_id, {PATH}, zone, candidate_text, reason, CAST(confidence AS DOUBLE) AS confidence, rkind AS kind FROM cand"),
)
register(
    "q_requirement_records", lambda s, d: _records(s, d).select("document_id", "requirement_id", "candidate_id", "block_id", "norm", "kind", "strategy", F.size("atomics").cast("long").alias("atoms")),
    O.requirements("SELECT document_id, printf('reqr_%04d', n) AS requirement_id, printf('reqc_%04d', n) AS candidate_id, bid AS block_id, rnorm AS norm, rkind AS kind, strategy, na AS atoms FROM v0"),
)
register(
    "q_atomics", lambda s, d: R.atomics(_records(s, d)),
    O.requirements("SELECT document_id, requirement_id, strategy, atomic_id, atext AS text, subject, action, object, condition, span, CAST(confidence AS DOUBLE) AS confidence FROM atoms"),
)
register(
    "q_review_cases", lambda s, d: R.review_cases(_records(s, d)).select("document_id", "case_id", "requirement_id", "ambiguity", "strategy", _csv("context_ids"), F.col("atomic_count").cast("long").alias("atomic_count"), "norm"),
    O.requirements("SELECT document_id, printf('reqv_%04d', cno) AS case_id, printf('reqr_%04d', n) AS requirement_id, ambiguity, strategy, context AS context_ids, na AS atomic_count, rnorm AS norm FROM cases"),
)


def _decisions(s: SparkSession, d: str) -> DataFrame:
    made = R.baseline_decisions(_records(s, d))
    return made.select("document_id", "decision_id", "case_id", "requirement_id", "label", "action", "confidence", _csv("targets"), R.apply_policy(made).alias("policy"))


register(
    "q_review_decisions", _decisions,
    O.requirements("""SELECT document_id, printf('reqd_%04d', cno) AS decision_id, printf('reqv_%04d', cno) AS case_id, printf('reqr_%04d', n) AS requirement_id, label, act AS action, CAST(dconf AS DOUBLE) AS confidence, aids AS targets, policy FROM lo"""),
)
register(
    "q_applied", lambda s, d: _applied(s, d)[1].select("document_id", "applied_id", "requirement_id", "strategy", _csv("operations"), _csv("flags"), F.array_join(F.transform("atomics", lambda a: F.coalesce(a["subject"], F.lit("-"))), "|").alias("subjects")),
    O.requirements("""SELECT document_id, printf('appr_%04d', n) AS applied_id, printf('reqr_%04d', n) AS requirement_id, ap.strategy, CASE WHEN policy = 'requires_human_review' THEN '' ELSE op END AS operations, flag AS flags, coalesce(subjects, '') AS subjects
        FROM ap LEFT JOIN (SELECT document_id, n, string_agg(coalesce(subject, '-'), '|' ORDER BY ano) AS subjects FROM aa WHERE ano IS NOT NULL GROUP BY ALL) USING (document_id, n)"""),
)
register(
    "q_apply_log", lambda s, d: _applied(s, d)[2].select("document_id", "apply_id", "decision_id", "requirement_id", "policy", "operation", "applied", _csv("operations"), _csv("flags")),
    O.requirements("SELECT document_id, printf('reqap_%04d', cno) AS apply_id, printf('reqd_%04d', cno) AS decision_id, printf('reqr_%04d', n) AS requirement_id, policy, act AS operation, done AS applied, op AS operations, flag AS flags FROM lo"),
)


def _apply_summary(s: SparkSession, d: str) -> DataFrame:
    _, applied, log = _applied(s, d)
    return R.apply_summary(applied, log).withColumn("operation_counts", F.array_join("operation_counts", ","))


register(
    "q_apply_summary", _apply_summary,
    O.requirements("""SELECT document_id, oc AS operation_counts, coalesce(total, 0) AS total, coalesce(automatic, 0) AS automatic, coalesce(applied, 0) AS applied, coalesce(unresolved, 0) AS unresolved, CAST(0 AS BIGINT) AS unsupported FROM
        (SELECT document_id, string_agg(op || '=' || c, ',' ORDER BY op || '=' || c) AS oc FROM (SELECT document_id, op, count(*) AS c FROM ap GROUP BY ALL) GROUP BY 1)
        LEFT JOIN (SELECT document_id, count(*) AS total, count(*) FILTER (policy = 'auto_applicable') AS automatic, count(*) FILTER (done) AS applied, count(*) FILTER (policy = 'requires_human_review') AS unresolved FROM lo GROUP BY 1) USING (document_id)"""),
)
register(
    "q_questions", lambda s, d: R.questions(R.question_rows(_applied(s, d)[1], S.ENGLISH)).select("document_id", "question_id", "applied_id", "atomic_id", "block_id", _path(), "question_text", "question_type", "reason"),
    O.requirements(f"SELECT document_id, printf('aq_%04d', qno) AS question_id, printf('appr_%04d', n) AS applied_id, atomic_id, bid AS block_id, {PATH}, qtext AS question_text, qt AS question_type, 'safe_' || qt AS reason FROM qu"),
)
QUESTION_SUMMARY = """SELECT document_id, count(*) FILTER (skip IS NULL) AS total_questions, count(*) FILTER (skip = 'context_only') AS skipped_context_only, count(*) FILTER (skip = 'unresolved') AS skipped_unresolved,
    count(*) FILTER (skip = 'non_actionable') AS skipped_non_actionable, count(*) FILTER (skip IS NULL AND qt = 'evidence_check') AS evidence_check, count(*) FILTER (skip IS NULL AND qt = 'implementation_check') AS implementation_check,
    count(*) FILTER (skip IS NULL AND qt = 'process_check') AS process_check FROM g2 GROUP BY 1"""
register("q_question_summary", lambda s, d: R.question_summary(R.question_rows(_applied(s, d)[1], S.ENGLISH)), O.requirements(QUESTION_SUMMARY))


def _lineage(s: SparkSession, d: str) -> DataFrame:
    return R.carried_lineage(R.questions(R.question_rows(_applied(s, d)[1], S.ENGLISH)))


register(
    "q_trace_lineage", _lineage,
    O.requirements("""SELECT qu.document_id, qu.bid AS block_id, printf('reqr_%04d', qu.n) AS requirement_id, printf('appr_%04d', qu.n) AS applied_id, printf('aq_%04d', qno) AS question_id, printf('reqc_%04d', qu.n) AS candidate_id, r2.block_order, r2.bt AS block_type
        FROM qu JOIN r2 ON r2.document_id = qu.document_id AND r2.bid = qu.bid"""),
)
NAMES = ["non_empty_document", "structure_summary_consistency", "enum_domain_validity", "adjacent_block_links", "table_block_payloads", "note_block_review_readiness", "section_context_validity", "review_candidates_build", "review_candidates_links"]
BAD = {  # what each check counts, over the blocks of a document
    "enum_domain_validity": f"bt NOT IN ({', '.join(map(repr, S.BLOCK_TYPES))}) OR zone NOT IN ({', '.join(map(repr, S.ZONES))})",
    "adjacent_block_links": "pid IS DISTINCT FROM pb OR nid IS DISTINCT FROM nb",
    "table_block_payloads": "bt = 'table' AND (table_rows IS NULL OR table_cols IS NULL)",
    "note_block_review_readiness": "bt IN ('note_label', 'note_text', 'note_like') AND lf IS NULL",
    "section_context_validity": """bt IN ('heading', 'appendix_heading', 'paragraph', 'list_item', 'table') AND zone IN ('main_body', 'appendix')
        AND ((bt IN ('heading', 'appendix_heading') AND sid IS NULL) OR coalesce(len(path) > 0 AND path[-1] <> sid, false))""",
    "review_candidates_build": "len(reasons) > 0 AND (bid IS NULL OR bt IS NULL OR zone IS NULL)",
}
COUNTS = {"total_tables": "table", "total_list_items": "list_item", "total_template_instructions": "template_instruction", "total_sections": "heading", "total_appendix_sections": "appendix_heading", "total_figures": "figure", "total_formulas": "formula"}
NOTE_COUNT = "count(DISTINCT CASE WHEN bt IN ('note_label', 'note_text') THEN nullif(grp, '') END) + count(*) FILTER (bt IN ('note_label', 'note_text') AND nullif(grp, '') IS NULL) + count(*) FILTER (bt = 'note_like')"
WRONG = "CASE WHEN notes <> note_rows THEN 1 ELSE 0 END"  # the other counters are counted the same way
ISSUES = {"non_empty_document": "CASE WHEN total = 0 THEN 1 ELSE 0 END", "structure_summary_consistency": WRONG, "review_candidates_links": "0", **{n: f"coalesce(n_{n}, 0)" for n in BAD}}
FOUND = {"structure_summary_consistency": "CASE WHEN notes <> note_rows THEN 'total_notes' END", **{n: f"f_{n}" for n in BAD}}
CHECKS = f"""SELECT document_id, u.name AS name, CASE WHEN u.issues = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(u.issues AS BIGINT) AS issues, coalesce(u.found, '') AS offending FROM (
    SELECT document_id, unnest([{", ".join(f"{{'name': '{n}', 'issues': {ISSUES[n]}, 'found': {FOUND.get(n, 'NULL')}}}" for n in NAMES)}]) AS u FROM (
        SELECT d.document_id, coalesce(total, 0) AS total, coalesce(notes, 0) AS notes, coalesce(note_rows, 0) AS note_rows, {", ".join(f"n_{n}, f_{n}" for n in BAD)}
        FROM (SELECT DISTINCT doc_id AS document_id FROM documents) d LEFT JOIN (
            SELECT document_id, count(*) AS total, {NOTE_COUNT} AS notes, count(*) FILTER (bt IN ('note_label', 'note_text', 'note_like')) AS note_rows,
                {", ".join(f"count(*) FILTER ({bad}) AS n_{n}, string_agg(bid, ',' ORDER BY block_order) FILTER ({bad}) AS f_{n}" for n, bad in BAD.items())}
            FROM (SELECT *, lag(bid) OVER w AS pb, lead(bid) OVER w AS nb FROM r2 WINDOW w AS (PARTITION BY document_id ORDER BY block_order)) GROUP BY document_id) USING (document_id)))"""


def _checks(s: SparkSession, d: str) -> DataFrame:
    return validate.run_checks(_line_base(s, d), A.read_table(s, d, "documents").select(F.col("doc_id").alias("document_id")))


register("q_validation_checks", lambda s, d: _checks(s, d).drop("message").withColumn("offending", F.array_join("offending", ",")), O.lines(CHECKS))
register(
    "q_validation_report", lambda s, d: validate.report(_checks(s, d)),
    O.lines(f"SELECT document_id, count(*) AS total_checks, count(*) FILTER (status = 'passed') AS passed_checks, CAST(0 AS BIGINT) AS warning_checks, count(*) FILTER (status = 'failed') AS failed_checks, bool_and(status <> 'failed') AS downstream_ready FROM ({CHECKS}) GROUP BY 1"),
)
register(
    "q_validation_failures", lambda s, d: validate.failures_by_check(_checks(s, d)),
    O.lines(f"SELECT name, count(*) AS failures FROM ({CHECKS}) WHERE status = 'failed' GROUP BY 1"),
)


def _inputs(s: SparkSession, d: str) -> DataFrame:
    """Page addresses as paths: every third exists as a document file, some are of another kind."""
    pages, n = A.read_table(s, d, "pages"), F.col("page_id") % 5
    path = F.concat(F.regexp_extract("url", "^https?://([^/?]+)", 1), F.lit("/"), (F.col("page_id") % 40).cast("string"), F.when(n == 0, ".DOCX").when(n == 1, ".txt").otherwise(".docx"))
    return pages.select(path.alias("path"), (F.col("page_id") % 3 != 0).alias("exists"))


register(
    "q_validation_messages", lambda s, d: _checks(s, d).groupBy("name", "status", "message").agg(F.count(F.lit(1)).alias("documents")),
    O.lines(f"""SELECT name, status, CASE {" ".join(f"WHEN name = '{n}' AND status = '{st}' THEN '{m[k]}'" for n, m in validate.MESSAGES.items() for k, st in enumerate(("passed", "failed")))} END AS message, count(*) AS documents
        FROM ({CHECKS}) GROUP BY ALL"""),
)


def _stored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored documents with one fault each, by the remainder of their ids, their candidates and their summaries."""
    base = _line_base(s, d)
    stored, fault = render.read_document_json(render.document_json(base)), F.col("document_id") % 11
    spoil = lambda c, n, bad, test=None: F.when((fault == n) & (F.lit(True) if test is None else test), bad).otherwise(F.col(c))
    kind, order, nothing = F.col("block_type"), F.col("block_order"), F.lit(None)
    blocks = stored.filter(fault != 9).select(*[c for c in stored.columns if c not in ("block_type", "zone", "next_id", "table_cols", "list_follows", "section_id", "block_id")],
        spoil("block_type", 2, F.lit("riddle"), (kind == "paragraph") & (order % 5 == 0)).alias("block_type"), spoil("zone", 3, F.lit("nowhere"), order % 7 == 0).alias("zone"), spoil("next_id", 4, F.lit("b999999"), order == 2).alias("next_id"),
        spoil("table_cols", 5, nothing).alias("table_cols"), spoil("list_follows", 6, nothing).alias("list_follows"), spoil("section_id", 7, nothing).alias("section_id"), spoil("block_id", 10, nothing, F.size("reasons") > 0).alias("block_id"))
    candidates = B.review_candidates(base).select("document_id", "candidate_id", spoil("block_id", 8, F.lit("b999999"), F.col("candidate_id").endswith("1")).alias("block_id"))
    summary = B.structure_summary(base)
    return blocks, candidates, summary.withColumn("total_tables", F.when(fault == 1, F.col("total_tables") + 1).otherwise(F.col("total_tables")))


def _stored_checks(s: SparkSession, d: str) -> DataFrame:
    blocks, candidates, summary = _stored(s, d)
    loud = validate.Check("no_shouting", "No block is all capitals.", "Some blocks are all capitals.", lambda b: (F.upper("norm") == F.col("norm")) & F.col("norm").rlike("[A-Z]"))
    found = validate.run_checks(blocks, A.read_table(s, d, "documents").select(F.col("doc_id").alias("document_id")), candidates, summary, [*validate.CHECKS, loud])
    return found.drop("message").withColumn("offending", F.array_join("offending", ","))


SPOILT = {
    "spoilt": """SELECT * REPLACE (CASE WHEN document_id % 11 = 2 AND bt = 'paragraph' AND block_order % 5 = 0 THEN 'riddle' ELSE bt END AS bt, CASE WHEN document_id % 11 = 3 AND block_order % 7 = 0 THEN 'nowhere' ELSE zone END AS zone,
        CASE WHEN document_id % 11 = 4 AND block_order = 2 THEN 'b999999' ELSE nid END AS nid, CASE WHEN document_id % 11 <> 5 THEN table_cols END AS table_cols, CASE WHEN document_id % 11 <> 6 THEN lf END AS lf,
        CASE WHEN document_id % 11 <> 7 THEN sid END AS sid, CASE WHEN document_id % 11 = 10 AND len(reasons) > 0 THEN NULL ELSE bid END AS bid) FROM r2 WHERE document_id % 11 <> 9""",
    "stated": f"SELECT document_id, count(*) AS total_blocks, {', '.join(f'count(*) FILTER (bt = {k!r})' + (' + CASE WHEN document_id % 11 = 1 THEN 1 ELSE 0 END' if n == 'total_tables' else '') + f' AS {n}' for n, k in COUNTS.items())}, {NOTE_COUNT} AS total_notes FROM r2 GROUP BY 1",
    "named": """SELECT document_id, printf('rc_%04d', row_number() OVER (PARTITION BY document_id ORDER BY block_order)) AS cid, bid FROM r2 WHERE len(reasons) > 0""",
    "pointed": "SELECT document_id, cid, CASE WHEN document_id % 11 = 8 AND ends_with(cid, '1') THEN 'b999999' ELSE bid END AS bid FROM named",
    "lost": "SELECT document_id, count(*) AS n, string_agg(cid, ',' ORDER BY cid) AS ids FROM pointed ANTI JOIN spoilt USING (document_id, bid) GROUP BY 1",
    "actual": f"""SELECT document_id, count(*) AS total_blocks, {', '.join(f'count(*) FILTER (bt = {k!r}) AS {n}' for n, k in COUNTS.items())}, count(*) FILTER (bt IN ('note_label', 'note_text', 'note_like')) AS total_notes,
        {", ".join(f"count(*) FILTER ({bad}) AS n_{n}, string_agg(bid, ',' ORDER BY block_order) FILTER ({bad}) AS f_{n}" for n, bad in {**BAD, 'no_shouting': "upper(norm) = norm AND regexp_matches(norm, '[A-Z]')"}.items())}
        FROM (SELECT *, lag(bid) OVER w AS pb, lead(bid) OVER w AS nb FROM spoilt WINDOW w AS (PARTITION BY document_id ORDER BY block_order)) GROUP BY 1""",
    "compared": f"""SELECT d.document_id, coalesce(a.total_blocks, 0) AS total, coalesce(lost.n, 0) AS nlost, coalesce(lost.ids, '') AS lost_ids,
        concat_ws(',', {', '.join(f"CASE WHEN coalesce(a.{n}, 0) <> coalesce(s.{n}, 0) THEN '{n}' END" for n in ['total_blocks', *COUNTS, 'total_notes'])}) AS differing, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}, f_{n}' for n in [*BAD, 'no_shouting'])}
        FROM (SELECT DISTINCT doc_id AS document_id FROM documents) d LEFT JOIN actual a USING (document_id) LEFT JOIN stated s USING (document_id) LEFT JOIN lost USING (document_id)""",
}
STORED = f"""SELECT document_id, u.name AS name, CASE WHEN u.issues = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(u.issues AS BIGINT) AS issues, coalesce(u.found, '') AS offending FROM (SELECT document_id, unnest([
    {{'name': 'non_empty_document', 'issues': CASE WHEN total = 0 THEN 1 ELSE 0 END, 'found': ''}}, {{'name': 'structure_summary_consistency', 'issues': CASE WHEN differing = '' THEN 0 ELSE len(string_split(differing, ',')) END, 'found': differing}},
    {{'name': 'review_candidates_links', 'issues': nlost, 'found': lost_ids}}, {", ".join(f"{{'name': '{n}', 'issues': n_{n}, 'found': f_{n}}}" for n in [*BAD, 'no_shouting'])}]) AS u FROM compared)"""
register("q_validation_stored", _stored_checks, O.composed({**O.analysis_sql(O.lines_sql(), S.LINE_STYLES), **SPOILT}, STORED))
register("q_validation_damaged", lambda s, d: fixtures.damaged_checks(s), fixtures.DAMAGED)
register("q_zone_rules", lambda s, d: fixtures.russian_zones(s), fixtures.ZONES)
register("q_russian_blocks", lambda s, d: fixtures.russian_blocks(s), fixtures.BLOCKS)
register("q_review_default", lambda s, d: fixtures.default_decision(s), fixtures.DEFAULT)
register("q_review_lines", lambda s, d: fixtures.review_lines(s), fixtures.LINES)


INPUTS = """SELECT regexp_extract(url, '^https?://([^/?]+)', 1) || '/' || page_id % 40 || CASE page_id % 5 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.txt' ELSE '.docx' END AS path, page_id % 3 <> 0 AS found FROM pages"""
register("q_discover_inputs", lambda s, d: validate.discover(_inputs(s, d))[0], f"SELECT DISTINCT path FROM ({INPUTS}) WHERE found AND ends_with(lower(path), '.docx')")
register(
    "q_discover_issues", lambda s, d: validate.discover(_inputs(s, d))[1],
    f"""SELECT path AS input_path, CASE WHEN NOT found THEN 'failed' ELSE 'warning' END AS status, CASE WHEN NOT found THEN 'Input path does not exist.' ELSE 'Skipped non-DOCX input path.' END AS message
        FROM ({INPUTS}) WHERE NOT found OR NOT ends_with(lower(path), '.docx')""",
)
def _batch(s: SparkSession, d: str) -> DataFrame:
    found = validate.batch(_checks(s, d), validate.discover(_inputs(s, d))[1])
    return found.withColumn("failed_checks", F.array_join(F.transform("failed_checks", lambda x: F.concat_ws(":", x["name"], x["failures"].cast("string"))), ","))


register(
    "q_validation_batch", _batch,
    O.lines(f"""SELECT count(*) AS total_documents, count(*) FILTER (state = 'passed') AS passed_documents, count(*) FILTER (state = 'failed') AS failed_documents, count(*) FILTER (state = 'warning') AS warnings,
        (SELECT string_agg(name || ':' || n, ',' ORDER BY name) FROM (SELECT name, count(*) AS n FROM ({CHECKS}) WHERE status = 'failed' GROUP BY name)) AS failed_checks FROM (
        SELECT CASE WHEN bool_and(status <> 'failed') THEN 'passed' ELSE 'failed' END AS state FROM ({CHECKS}) GROUP BY document_id
        UNION ALL SELECT CASE WHEN NOT found THEN 'failed' ELSE 'warning' END FROM ({INPUTS}) WHERE NOT found OR NOT ends_with(lower(path), '.docx'))"""),
)
MARK = "coalesce(" + ", ".join(rf"nullif(regexp_extract(norm, '^\s*({x})\s+', 1), '')" for x in (r"[A-Za-zА-Яа-я]\)", "[0-9]+[.)]", "[-•–]")) + ")"
PREFIX = "CASE WHEN bt = 'list_item' THEN repeat('  ', coalesce(rlevel, 0)) || coalesce(mark, '-') || ' ' ELSE '' END"
RENDER = f"""SELECT document_id, block_order, printf('[BLOCK %04d] id=%s | type=%s | zone=%s | section=%s | style=%s', block_order, bid, bt, zone, coalesce(nullif(array_to_string(path, ' > '), ''), '-'), coalesce(nullif(style, ''), '-')) AS header,
    CASE WHEN guessed OR coalesce(orphan, false) OR (emp AND bt <> 'empty') THEN '[REVIEW] ' || concat_ws(' | ', CASE WHEN guessed THEN 'needs_review' END, CASE WHEN guessed THEN 'suspicious' END,
        CASE WHEN guessed OR coalesce(orphan, false) THEN 'unresolved' END, CASE WHEN emp AND bt <> 'empty' THEN 'flag:is_empty' END) END AS hint,
    CASE WHEN bt = 'table' AND table_rows IS NULL AND table_cols IS NULL THEN '[TABLE BLOCK WITHOUT TABLE_INFO]'
        WHEN bt = 'table' THEN printf('table_id=- | rows=%d | cols=%d | style=%s | header_row=%s', coalesce(table_rows, 0), coalesce(table_cols, 0), coalesce(nullif(style, ''), '-'), CASE WHEN table_rows > 0 THEN 'True' ELSE 'False' END)
            || CASE WHEN coalesce(table_rows, 0) = 0 OR coalesce(table_cols, 0) = 0 THEN chr(10) || '[EMPTY TABLE]' ELSE '' END
        WHEN bt = 'empty' THEN '[EMPTY BLOCK]' || CASE WHEN norm = '' THEN '' ELSE ' ' || norm END WHEN bt = 'unknown' THEN '[UNKNOWN BLOCK]' || CASE WHEN norm = '' THEN '' ELSE ' ' || norm END
        ELSE {PREFIX} || CASE WHEN norm = '' THEN '[NO TEXT]' ELSE norm END END AS body,
    bt <> 'empty' AS show, coalesce(orphan, false) OR guessed AS unresolved FROM (SELECT *, {MARK} AS mark FROM r2)"""
register("q_render_rows", lambda s, d: render.render_rows(_page_base(s, d)), O.pages(RENDER))
register("q_render_rows_docs", lambda s, d: render.render_rows(_line_base(s, d)), O.lines(RENDER))
register(
    "q_render_lines", lambda s, d: render.text_lines(_page_base(s, d)),
    O.pages(f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_order, i) AS line_no, line FROM (
        SELECT document_id, block_order, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT document_id, block_order, list_filter([header, hint, body], lambda x: x IS NOT NULL) AS l FROM ({RENDER})))"""),
)
register(
    "q_document_json", lambda s, d: render.read_document_json(render.document_json(_line_base(s, d))).select("document_id", "block_id", "block_order", "zone", "block_type", "norm", F.coalesce(F.array_join("section_path", "/"), F.lit("")).alias("path"), "note_group", F.array_join("reasons", ",").alias("reasons")),
    O.lines(f"SELECT document_id, bid AS block_id, block_order, zone, bt AS block_type, norm, {PATH}, grp AS note_group, array_to_string(reasons, ',') AS reasons FROM r2"),
)


register(
    "q_list_formatting", lambda s, d: api.with_list_formatting(_line_base(s, d)).filter("list_formatting IS NOT NULL").select("document_id", "list_formatting.*").withColumn("level", F.col("level").cast("long")),
    O.lines(r"""SELECT document_id, bid AS list_id, CAST(coalesce(rlevel, 0) AS BIGINT) AS level, 'bulleted' AS marker_type, coalesce(nullif(regexp_extract(norm, '^\s*([-•–])\s+', 1), ''), nullif(regexp_extract(text, '^\s*([-•–]|[0-9]+[.)]|[A-Za-zА-Яа-я]\))', 1), ''), '-') AS marker_text,
        'bullet' AS numbering_style FROM r2 WHERE bt = 'list_item'"""),
)
register(
    "q_whole_document",
    lambda s, d: render.read_document_parts(render.whole_document_json(_line_base(s, d), "lines")).withColumn("styles", F.array_join("styles", ",")),
    O.lines(f"""SELECT document_id, CAST(document_id AS VARCHAR) AS path, 'lines' AS template_id, {", ".join(render.COUNTERS)}, styles FROM ({SUMMARY}) JOIN (
        SELECT document_id, coalesce(string_agg(DISTINCT style, ',' ORDER BY style) FILTER (style <> ''), '') AS styles FROM r2 GROUP BY 1) USING (document_id)"""),
)
register(
    "q_casefold",
    lambda s, d: A.read_table(s, d, "documents").select(F.explode(F.split(t.folded(F.coalesce("text", F.lit(""))), r"[\s]+")).alias("word")).filter("contains(word, 'ss')").groupBy("word").agg(F.count(F.lit(1)).alias("times")),
    r"SELECT word, count(*) AS times FROM (SELECT unnest(string_split_regex(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[ \t\n\x0B\f\r]+')) AS word FROM documents) WHERE contains(word, 'ss') GROUP BY 1",
)


def _strict(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored documents, some with a fault in their JSON by the remainder of their ids, read strictly."""
    texts, fault, json = render.document_json(_line_base(s, d)), F.col("document_id") % 7, F.col("json")
    swap = lambda a, b: F.replace(json, F.lit(a), F.lit(b))
    damaged = (
        F.when(fault == 0, F.concat(F.lit('{"extra":1,'), F.substring("json", 2, 1 << 30))).when(fault == 1, swap('"block_order":1,', '"block_order":"1",'))
        .when(fault == 2, swap('"block_type":"list_item"', '"block_type":"riddle"')).when(fault == 3, F.substring(json, F.lit(1), F.floor(F.length(json) / 2).cast("int"))).when(fault == 4, swap('"block_id":"b000002",', "")).otherwise(json)
    )
    return strict.read_documents(texts.select(F.col("document_id").cast("string").alias("name"), damaged.alias("json")))


register(
    "q_strict_problems", lambda s, d: _strict(s, d)[1],
    O.lines("""SELECT CAST(document_id AS VARCHAR) AS name, 'extra' AS path, 'unknown key' AS problem FROM r2 WHERE document_id % 7 = 0 GROUP BY document_id
        UNION ALL SELECT CAST(document_id AS VARCHAR), 'blocks[0].block_order', 'wrong type: STRING' FROM r2 WHERE document_id % 7 = 1 GROUP BY document_id
        UNION ALL SELECT CAST(document_id AS VARCHAR), 'blocks[' || block_order - 1 || '].block_type', 'unknown value' FROM r2 WHERE document_id % 7 = 2 AND bt = 'list_item'
        UNION ALL SELECT CAST(document_id AS VARCHAR), '', 'not a JSON object' FROM r2 WHERE document_id % 7 = 3 GROUP BY document_id
        UNION ALL SELECT CAST(document_id AS VARCHAR), 'blocks[1].block_id', 'missing key' FROM r2 WHERE document_id % 7 = 4 AND block_order = 2"""),
)
register(
    "q_strict_documents", lambda s, d: _strict(s, d)[0].select("document_id", "block_id", "block_order", "zone", "block_type", "norm", F.array_join("reasons", ",").alias("reasons")),
    O.lines("""SELECT document_id, bid AS block_id, block_order, zone, bt AS block_type, norm, array_to_string(reasons, ',') AS reasons FROM r2
        WHERE document_id % 7 > 4 OR document_id NOT IN (SELECT document_id FROM r2 WHERE document_id % 7 IN (0, 1, 3) OR (document_id % 7 = 2 AND bt = 'list_item') OR (document_id % 7 = 4 AND block_order = 2))"""),
)


def _flagship(s: SparkSession, d: str) -> DataFrame:
    base = _line_base(s, d)
    records = R.records(R.candidates(base, S.ENGLISH), S.ENGLISH)
    applied, _ = R.apply_baseline(records, S.ENGLISH)
    return B.structure_summary(base).join(R.question_summary(R.question_rows(applied, S.ENGLISH)), "document_id", "left")


register("q_flagship", _flagship, O.requirements(f"SELECT * FROM ({SUMMARY}) LEFT JOIN ({QUESTION_SUMMARY}) USING (document_id)"))

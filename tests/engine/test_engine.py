import zipfile

import pytest
from pyspark.sql import functions as F

from blockloom import api
from blockloom.operators import blocks as B
from blockloom.operators import render, tables, validate
from blockloom.operators import requirements as R
from blockloom.sources import adapters, docx, sinks
from blockloom.sources import rules as S
from blockloom.streaming import folder

RULES = [
    ("Heading 1", "heading", "main_heading", "main_body", 1, None, None, []), ("Heading 2", "heading", "main_heading", "main_body", 2, None, None, []),
    ("Normal", "paragraph", "main_text", "main_body", None, None, None, []), ("Оглавление 1", "toc_item", "toc_level_1", "toc", 1, None, None, []),
    ("Список", "list_item", "dash", "main_body", None, "bulleted_dash", 1, []), ("Титул", "title_meta", "meta", "title_page", None, None, None, ["is_front_matter"]),
    ("05_ИЦЖТ_Примечание_слово", "note_like", "note_label", "main_body", None, None, None, []), ("05_ИЦЖТ_Примечание_текст после", "note_like", "note_text", "main_body", None, None, None, []),
    ("Odd", "no_such_type", None, "no_such_zone", None, None, None, ["no_such_flag"]),
]


@pytest.fixture(scope="module")
def rules(spark):
    return S.style_rules(spark, RULES).cache()


def rows_of(spark, texts, document=1):
    rows = [(document, i, "table" if style == "TABLE" else "paragraph", None if style == "TABLE" else style, text) for i, (style, text) in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "document_id long, block_order long, kind string, style string, text string")


def analysed(spark, rules, texts):
    return B.analysed(rows_of(spark, texts), rules, S.RUSSIAN).orderBy("block_order").collect()


def test_layout_equals_a_plain_grid(spark):
    """Random tables with merged cells and rows of different lengths, against a grid that is filled row by row."""
    import random

    rng, rows, want = random.Random(3), [], {}
    for doc in range(60):
        grid = {}
        for r in range(rng.randint(1, 7)):
            at = 0
            for place in range(rng.randint(1, 5)):
                span, merge = rng.choice([1, 1, 2, 3]), rng.choice([None, "restart", "continue", "continue"])
                rows.append((doc, r, place, span, merge, f"{r}-{place}", f"style {place}"))
                for c in range(at, at + span):
                    above = grid.get((r - 1, c))
                    grid[r, c] = above if merge == "continue" and above else (f"{r}:{at}", f"{r}-{place}", f"style {place}")
                at += span
        want |= {(doc, *k): v for k, v in grid.items()}
    cells = spark.createDataFrame(rows, "document_id long, row long, place long, span long, merge string, text string, style string")
    laid = tables.layout(cells.repartition(3), ["style"])
    got = {(x.document_id, x.row, x.col): (x.cell_key, x.text, x.style) for x in laid.collect()}
    assert got == want
    for box in tables.spans(laid, ["style"]).collect():
        own = [k[1:] for k, v in want.items() if k[0] == box.document_id and v[0] == box.cell_key]
        tall, wide = [r for r, _ in own], [c for _, c in own]
        assert (box.row, box.col, box.row_span, box.col_span) == (min(tall), min(wide), max(tall) - min(tall) + 1, max(wide) - min(wide) + 1)


def test_types_zones_and_sections(spark, rules):
    got = analysed(spark, rules, [
        ("Титул", "Документ"), ("Normal", ""), ("Оглавление 1", "Введение 3"), ("Heading 1", "1 Назначение"), ("Normal", "Текст."), ("Heading 2", "1.1 Область"), ("TABLE", None),
        ("Heading 1", "Порядок"), ("Heading X", "Специалист должен проверить, что всё есть в архиве."), ("Heading X", "2 Порядок выполнения"), ("Heading 1", "Приложение Б Перечень документов"),
        ("Heading 1", "А.1 Форма записи"), ("Normal", "Текст"), ("Heading 1", "Без номера"), ("Normal", "Приложение А (рекомендуемое)"), ("Odd", "x"), ("Heading 1", "Содержание"),
    ])
    assert [r.block_type for r in got] == ["title_meta", "empty", "toc_item", "heading", "paragraph", "heading", "table", "heading", "paragraph", "heading", "appendix_heading", "appendix_heading", "paragraph", "appendix_heading", "appendix_heading", "unknown", "appendix_heading"]
    assert [r.zone for r in got] == ["title_page", "title_page", "toc", *["main_body"] * 7, *["appendix"] * 7]
    paths = ["", "", "", "1", "1", "1/1.1", "1/1.1", "UNNUMBERED_8", "UNNUMBERED_8", "2", "Б", "Б/А.1", "Б/А.1", "Б/APP_UNNUMBERED_14", "А", "А", "А/APP_UNNUMBERED_17"]
    assert ["/".join(r.section_path) for r in got] == paths
    assert got[10].heading_number == "Б" and got[11].heading_level == 2 and got[9].block_subtype == "style_heading_fallback" and got[8].block_subtype == "plain_paragraph_fallback"
    assert got[5].parent_section == "1" and got[0].flags == ["is_front_matter"] and got[8].flags == ["needs_review", "is_suspicious"]


def test_numbered_text_without_rule(spark, rules):
    got = analysed(spark, rules, [("Body", "3.2 Проверка записей и документов"), (None, "просто текст")])
    assert (got[0].block_type, got[0].block_subtype, got[0].heading_level, got[0].heading_title) == ("heading", "numbered_heading_fallback", 2, "Проверка записей и документов")
    assert got[1].zone == "main_body"


def next_zone(now, r, lex=S.RUSSIAN):
    """The zone after block r of a walk that is in zone now, decided case by case."""
    style, low = r.style.lower(), r.norm.lower()
    if r.kind == "table" or not r.norm:
        return now
    kind = r.in_type if now == "appendix" else r.out_type
    default = r.rule_zone if r.rule_type else "main_body"
    if kind == "appendix_heading" or r.root:
        return "appendix"
    if low == lex.control or lex.control in low and all(x in style for x in lex.control_styles):
        return "control_sheet"
    if low == lex.contents or any(x in style for x in lex.contents_styles) or kind == "toc_item":
        return "toc"
    if low == lex.sources or any(x in style for x in lex.source_styles) or kind == "bibliography_item":
        return "bibliography"
    if any(x in style for x in lex.title_styles) and now not in ("control_sheet", "toc", "main_body", "appendix", "bibliography"):
        return "title_page"
    if kind == "heading":
        return "main_body"
    if now in ("appendix", "bibliography", "control_sheet"):
        return now
    if now == "title_page" and (kind == "title_meta" or default == "main_body" and not style):
        return now
    return now if default == "unknown_zone" else default


def test_zone_scan_equals_walk_on_random_rules(spark):
    """The scan against a walk from block to block, for random rule tables with title styles."""
    import random

    rng = random.Random(5)
    styles = ["Титульный", "Title heading", "Heading 1", "Normal", "Структурный вне содержания", "Оглавление 1", "Odd", "Библиография", "Приложение heading", ""]
    texts = ["т", "", "с 1", "Глава", "Приложение А", "А.1 текст", "Библиография", "Контрольный лист", "новый контрольный лист", "Содержание", "длинный, заголовок.", "3.1 Раздел"]
    for _ in range(4):
        made = [(s, rng.choice(["paragraph", "heading", "title_meta", "list_item", "toc_item", "bibliography_item", "appendix_heading"]), None, rng.choice([*S.ZONES, "title_page", "template_instruction"]), rng.choice([None, 1, 2]), None, None, []) for s in styles if rng.random() < 0.6]
        rows = []
        for doc in range(80):
            pool = [(rng.choice(styles), rng.choice(texts)) for _ in range(6)]  # few kinds in a document, so that runs are long
            rows += [(doc, i, rng.choice(["paragraph"] * 9 + ["table"]), *rng.choice(pool)) for i in range(1, 30)]
        blocks = spark.createDataFrame(rows, "document_id long, block_order long, kind string, style string, text string")
        base = B.classified(blocks, S.style_rules(spark, made), S.RUSSIAN).withColumn("root", B.Shapes(S.RUSSIAN).appendix_text(F.col("norm")))
        now, doc = "title_page", None
        for r in base.orderBy("document_id", "block_order").collect():
            if r.document_id != doc:
                now, doc = "title_page", r.document_id
            assert r.zone_before == now
            now = next_zone(now, r)
            assert r.zone_after == now


def test_title_page_behind_a_titled_heading(spark):
    """A titled heading after the bibliography begins the body, from where a rule can lead back to the title page."""
    rules = S.style_rules(spark, [("Cover", "paragraph", None, "title_page", None, None, None, [])])
    got = analysed(spark, rules, [("Normal", "Библиография"), ("Title heading", "Глава"), ("Cover", "текст обложки."), ("Title", "ещё текст.")])
    assert [r.zone for r in got] == ["bibliography", "main_body", "title_page", "title_page"]


def test_sections_equal_stack(spark, rules):
    import random

    rng, rows = random.Random(1), []
    for doc in range(40):
        rows += [(doc, i, "paragraph", f"Heading {rng.randint(1, 2)}" if rng.random() < 0.7 else "Normal", f"Глава {i}") for i in range(1, 15)]
    for doc in range(40, 60):  # fifteen levels and more
        rows += [(doc, i, "paragraph", f"Heading {rng.choice([1, 2, 5, 9, 10, 11, 14, 15, 40])}", f"Глава {i}") for i in range(1, 40)]
    got = B.analysed(spark.createDataFrame(rows, "document_id long, block_order long, kind string, style string, text string"), rules, S.RUSSIAN).orderBy("document_id", "block_order").collect()
    assert max(r.heading_level or 0 for r in got) == 40 and max(len(r.section_path) for r in got) >= 6
    stack, doc = [], None
    for r in got:
        if r.document_id != doc:
            stack, doc = [], r.document_id
        if r.block_type == "heading":
            stack = [x for x in stack if x[0] < r.heading_level] + [(r.heading_level, f"UNNUMBERED_{r.block_order}")]
        assert r.section_path == [x[1] for x in stack]


def test_notes(spark, rules):
    label, text = "05_ИЦЖТ_Примечание_слово", "05_ИЦЖТ_Примечание_текст после"
    got = analysed(spark, rules, [("Heading 1", "1 Глава"), (label, "Примечание"), (text, "т"), (label, "Примечание"), ("Normal", "п"), (text, "т"), (label, "П"), (text, "т")])
    assert [r.note_group for r in got] == [None, "note_group_0001", "note_group_0001", None, None, None, "note_group_0002", "note_group_0002"]
    assert [r.is_orphan for r in got] == [None, False, False, True, None, True, False, False]
    summary = B.structure_summary(B.analysed(rows_of(spark, [("Heading 1", "1 Глава"), (label, "П"), (text, "т"), (label, "П")]), rules, S.RUSSIAN)).first()
    assert summary.total_notes == 2 and summary.total_sections == 1


def test_notes_keep_existing_groups(spark, rules):
    label, text = "05_ИЦЖТ_Примечание_слово", "05_ИЦЖТ_Примечание_текст после"
    base = B.classified(rows_of(spark, [("Heading 1", "1 Г"), (label, "П"), (text, "т"), (label, "П"), (text, "т")]), rules, S.RUSSIAN)
    base = base.withColumn("old_group", F.when(F.col("block_order").isin(2, 3), "note_group_0042"))
    got = B.with_notes(base, S.RUSSIAN).orderBy("block_order").collect()
    assert [r.note_group for r in got] == [None, "note_group_0042", "note_group_0042", "note_group_0043", "note_group_0043"]


REQUIREMENTS = [
    ("Heading 1", "3 Требования"), ("Normal", "Перечень должен содержать:"), ("Список", "- наименование продукции;"), ("Список", "- дату проверки;"),
    ("Normal", "Специалист должен зарегистрировать продукцию в журнале."), ("Normal", "Это описание."), ("Список", "- без связи"),
    ("Normal", "Исполнитель обязан проверить журнал; при выявлении ошибки запись подлежит корректировке."), ("Normal", "Организация должна вести реестр. Каждый процесс должен пересматриваться ежегодно."),
    ("Normal", "Должны быть: выполнены работы. Заказчик должен ждать."),
]


def test_requirement_chain(spark, rules):
    base = B.analysed(rows_of(spark, REQUIREMENTS), rules, S.RUSSIAN)
    found = api.requirement_records(base)
    records = found.orderBy("n").collect()
    assert [r.strategy for r in records] == ["list_header_context", "contextual_list_item", "contextual_list_item", "single_atomic", "semicolon_split", "sentence_split", "sentence_split"]
    first = records[1].atomics[0]
    assert (first.text, first.subject, first.action, first.object) == ("наименование продукции", None, "наименование", "продукции")
    split = records[4].atomics
    assert len(split) == 2 and split[1].condition == "при выявлении ошибки запись подлежит корректировке." and split[1].action is None
    cases = R.review_cases(found).orderBy("n").collect()
    assert [c.ambiguity for c in cases] == ["requires_list_item_context", "missing_subject_context", "missing_subject_context", "conditional_clause_scope", "mixed_subject_scope"]
    assert cases[0].context_ids == ["reqr_0002", "reqr_0003"] and cases[1].context_ids == ["reqr_0001"]
    applied, log = api.apply_reviews(found)
    rows = applied.orderBy("n").collect()
    assert rows[1].atomics[0].subject == "Перечень" and rows[0].operations == ["mark_context_only"] and rows[3].operations == ["keep_as_is"] and rows[4].flags == ["check_condition_attachment"]
    summary = R.apply_summary(applied, log).first()
    assert (summary.total, summary.automatic, summary.applied, summary.unresolved, summary.unsupported) == (5, 3, 3, 2, 0)
    asked = R.question_rows(applied, S.RUSSIAN)
    texts = [q.question_text for q in R.questions(asked).orderBy("question_id").collect()]
    assert "Как подтверждается специалист должен зарегистрировать продукцию в журнале?" in texts
    totals = R.question_summary(asked).first()
    assert totals.skipped_context_only == 1 and totals.skipped_unresolved == 4 and totals.total_questions == len(texts) == 5
    assert R.lineage(R.questions(asked), applied, found, base).count() == 5


def test_manual_decisions_accumulate(spark, rules):
    found = api.requirement_records(B.analysed(rows_of(spark, REQUIREMENTS[:1] + REQUIREMENTS[4:5]), rules, S.RUSSIAN))
    schema = "document_id long, case_no int, decision_id string, case_id string, requirement_id string, label string, action string, summary string, targets array<string>, confidence double, new_text string, new_subject string, new_action string, new_object string, new_condition string"
    made = [
        (1, 1, "d1", "c1", "reqr_0001", "manual", "apply_revised_atomic_text", "", ["reqa_0001_01"], 1.0, "Новый текст записи", None, None, None, None),
        (1, 2, "d2", "c2", "reqr_0001", "manual", "apply_hint_cleanup", "", ["reqa_0001_01"], 1.0, None, "Кто", None, None, None),
        (1, 3, "d3", "c3", "reqr_0001", "manual", "apply_hint_cleanup", "", ["reqa_0001_01"], 1.0, None, "Кто-то", "делает", None, None),
        (1, 4, "d4", "c4", "reqr_0001", "manual", "apply_hint_cleanup", "", ["other"], 1.0, None, "нет", None, None, None),
        (1, 5, "d5", "c5", "lost", "manual", "keep_as_is", "", [], 1.0, None, None, None, None, None),
        (1, 6, "d6", "c6", "reqr_0001", "manual", None, "", [], 1.0, None, None, None, None, None),
    ]
    applied, log = api.apply_reviews(found, decisions=spark.createDataFrame(made, schema))
    row = applied.first()
    atom = row.atomics[0]
    assert (row.applied_text, atom.new_text, atom.subject, atom.action) == ("Новый текст записи", "Новый текст записи", "Кто-то", "делает")
    assert row.operations == ["apply_revised_atomic_text", "apply_hint_cleanup", "attach_review_flag"] and row.flags == ["apply_hint_cleanup_unresolved", "manual"]
    entries = {r.decision_id: r for r in log.collect()}
    assert entries["d5"].flags == ["missing_source_requirement"] and not entries["d5"].applied and entries["d6"].policy == R.UNSUPPORTED and entries["d4"].operations == ["attach_review_flag"]


def test_review_reasons(spark, rules):
    got = analysed(spark, rules, [("Heading X", "Раздел со списком"), ("Normal", "Состав:"), ("Список", "- а"), ("Normal", "приложение А"), ("Normal", "А.1 прочее")])
    assert got[0].reasons == ["suspicious_heading", "fallback_heading"] and got[1].list_follows and got[1].ends_with_colon
    rows = B.review_candidates(B.analysed(rows_of(spark, [("Heading X", "Раздел"), ("Normal", "a"), ("Normal", "b")]), rules, S.RUSSIAN)).collect()
    assert rows[0].candidate_id == "rc_0001" and [x.block_id for x in rows[0].after] == ["b000002", "b000003"] and rows[0].before == []


def test_checks(spark, rules):
    base = B.analysed(rows_of(spark, REQUIREMENTS), rules, S.RUSSIAN).cache()
    assert validate.report(validate.run_checks(base)).first().downstream_ready
    broken = base.withColumn("next_id", F.lit("x")).withColumn("block_type", F.when(F.col("block_order") == 2, "odd").otherwise(F.col("block_type"))).withColumn("section_id", F.lit(None).cast("string"))
    failed = {r.name for r in validate.run_checks(broken).filter("status = 'failed'").collect()}
    assert failed == {"enum_domain_validity", "adjacent_block_links", "section_context_validity"}
    lost = spark.createDataFrame([(1, "rc_1", "nowhere"), (1, "rc_2", "b000001")], "document_id long, candidate_id string, block_id string")
    found = {r.name: (r.issues, r.offending) for r in validate.run_checks(base, candidates=lost).collect()}
    assert found["review_candidates_links"] == (1, ["rc_1"])
    summary = validate.batch(validate.run_checks(base), spark.createDataFrame([("a", "failed", ""), ("b", "warning", "")], "input_path string, status string, message string"))
    assert summary.first().asDict() == {"total_documents": 3, "passed_documents": 1, "failed_documents": 1, "warnings": 1, "failed_checks": []} and sinks.exit_code(summary) == 1


def test_tables(spark):
    cells = [(1, 0, 0, "a", "Merged "), (1, 0, 1, "a", "Merged "), (1, 1, 0, "b", "x"), (1, 1, 1, "c", " "), (1, 2, 0, "b", "x")]
    df = spark.createDataFrame(cells, "document_id long, row long, col long, cell_key string, text string")
    found = {r.cell_key: r for r in tables.spans(df).collect()}
    assert (found["a"].col_span, found["a"].row_span, found["b"].row_span, found["c"].text) == (2, 1, 2, None)
    grid = tables.grid(df).first()
    assert grid.cells == [["Merged", "Merged"], ["x", None], ["x", None]] and (grid.rows_count, grid.cols_count, grid.header_rows) == (3, 2, 1)


DOCUMENT = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="h1"/><w:jc w:val="center"/><w:ind w:left="360" w:firstLine="180"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="24"/><w:color w:val="FF0000"/><w:rFonts w:ascii="Arial"/></w:rPr><w:t>1 </w:t></w:r><w:r><w:t>Общие</w:t><w:tab/></w:r></w:p>
<w:p><w:r><w:t>Специалист должен вести журнал.</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>C</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>"""
STYLES = """<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:type="paragraph" w:default="1" w:styleId="n"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="h1"><w:name w:val="heading 1"/><w:basedOn w:val="n"/><w:pPr><w:keepNext/></w:pPr></w:style></w:styles>"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("docx")
    with zipfile.ZipFile(at / "one.docx", "w") as z:
        z.writestr("word/document.xml", DOCUMENT)
        z.writestr("word/styles.xml", STYLES)
    (at / "bad.DOCX").write_bytes(b"no archive")
    (at / "other.txt").write_text("x")
    return str(at)


def test_word_files(spark, rules, files):
    read = docx.read_docx(spark, files).cache()
    assert {r.path.rsplit("/")[-1]: (r.error or "")[:10] for r in read.collect()} == {"one.docx": "", "bad.DOCX": "BadZipFile"}
    blocks = docx.block_rows(read).orderBy("block_order").collect()
    assert [(b.kind, b.style, b.text) for b in blocks] == [("paragraph", "Heading 1", "1 Общие\t"), ("paragraph", "Normal", "Специалист должен вести журнал."), ("table", None, None)]
    one = blocks[0]
    assert (one.bold, one.left_indent, one.first_line_indent, one.paragraph.alignment, one.paragraph.left_pt, one.runs[0].font, one.runs[0].size_pt, one.runs[0].color, one.runs[1].bold) == (True, 360, 180, "center", 18.0, "Arial", 12.0, "FF0000", None)
    cells = docx.cell_rows(read)
    assert tables.grid(cells).first().cells == [["A", "A"], ["B", None], ["B", "C"]]
    assert {(r.row, r.col, r.row_span, r.col_span) for r in tables.spans(cells).collect()} == {(0, 0, 1, 2), (1, 0, 2, 1), (1, 1, 1, 1), (2, 1, 1, 1)}
    styles = {r.style_name: r for r in docx.style_catalog(read).collect()}
    assert styles["Heading 1"].base_style == "Normal" and styles["Heading 1"].paragraph.keep_next and styles["Normal"].paragraph is None and styles["Normal"].run is None
    base = B.analysed(docx.block_rows(read).select("document_id", "block_order", "kind", "style", "text"), rules, S.RUSSIAN)
    assert [r.block_type for r in base.orderBy("block_order").collect()] == ["heading", "paragraph", "table"]
    assert api.audit_questions(api.apply_reviews(api.requirement_records(base))[0]).count() == 1


def test_review_file_round_trip(spark, rules, tmp_path):
    base = B.analysed(rows_of(spark, REQUIREMENTS[:4]), rules, S.RUSSIAN)
    content = sinks.review_files(base).first().content
    lines = [r.line for r in render.text_lines(base).orderBy("line_no").collect()]
    assert [b["text"] for b in docx.decode(bytes(content))["blocks"]] == lines and lines[0].startswith("[BLOCK 0001] id=b000001 | type=heading")
    sinks.write_documents(base, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 1
    again = render.read_document_json(render.document_json(base, nulls=True))
    assert again.count() == 4


def test_stream(spark, rules, files, tmp_path):
    query = folder.watch(spark, files, rules, S.RUSSIAN, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/blocks")).count() == 3 and spark.read.parquet(str(tmp_path / "out/errors")).count() == 1


def test_list_formatting(spark):
    row = spark.range(1).select(docx.list_formatting(F.lit("list_item"), F.lit("numbered"), F.lit(None).cast("string"), F.lit("2) x"), F.lit("b1"), F.lit(1)).alias("f")).first().f
    assert (row.marker_text, row.numbering_style, row.list_id) == ("2)", "numbered", "b1")


def test_discover(spark):
    paths = spark.createDataFrame([("a.docx", True), ("a.docx", True), ("b.txt", True), ("c.docx", False), ("D.DOCX", True)], "path string, exists boolean")
    good, issues = validate.discover(paths)
    assert {r.path for r in good.collect()} == {"a.docx", "D.DOCX"} and {(r.input_path, r.status) for r in issues.collect()} == {("b.txt", "warning"), ("c.docx", "failed")}


def test_documents_keep_tables_and_runs(spark, files, tmp_path):
    base = api.parse_documents(spark, files).orderBy("block_order").cache()
    heading, text, table = base.collect()
    assert heading.runs[0].font == "Arial" and heading.paragraph.alignment == "center" and text.table_id is None
    assert (table.table_id, table.table_rows, table.table_cols, table.cells) == ("tbl_0001", 3, 2, [["A", "A"], ["B", None], ["B", "C"]])
    body = "table_id=tbl_0001 | rows=3 | cols=2 | style=- | header_row=True\nA\tA\nB\t\nB\tC"
    assert render.render_rows(base).filter("block_order = 3").first().body == body
    assert {(r.row, r.col, r.row_span, r.col_span) for r in api.parse_table(spark, files, 1).filter("row_span IS NOT NULL").collect()} == {(0, 0, 1, 2), (1, 0, 2, 1), (1, 1, 1, 1), (2, 1, 1, 1)}
    # Review documents from stored JSON are those of the blocks themselves.
    sinks.write_documents(base, str(tmp_path / "json"))
    api.export_review_json(spark, str(tmp_path / "json"), str(tmp_path / "again"))
    api.export_review(base, str(tmp_path / "own"))
    texts = [[b["text"] for b in docx.decode(bytes(spark.read.parquet(str(tmp_path / x)).first().content))["blocks"]] for x in ("again", "own")]
    assert texts[0] == texts[1] and body.split("\n")[0] in texts[0][-1]
    reports = {r.document_id.rsplit("/")[-1]: r.downstream_ready for r in api.validate_folder(spark, files).collect()}
    assert reports == {"one.docx": True, "bad.DOCX": False}


def test_minimal_json_gets_defaults(spark):
    frame = spark.createDataFrame([('{"document_id": 1, "blocks": [{"block_id": "b1", "block_order": 1}]}',)], "json string")
    row = render.read_document_json(frame).first()
    assert (row.zone, row.block_type, row.norm, row.flags, row.cells) == ("unknown_zone", "unknown", "", [], None)
    assert render.render_rows(render.read_document_json(frame)).first().body == "[UNKNOWN BLOCK]"


def test_inline_marks_stay_in_a_block(spark):
    pages = spark.createDataFrame([(1, "<p>a <i>b</i> <a href='x'>c</a> d</p><li><b>e</b> f</li><blockquote>g</blockquote>")], "page_id long, html string")
    assert [(r.style, r.text) for r in adapters.page_blocks(pages).orderBy("block_order").collect()] == [("p", "a b c d"), ("li", "e f")]

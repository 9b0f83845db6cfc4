"""Rule sets: styles, anchor words and lexicons are data that every operator takes as a parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

STYLE_SCHEMA = "style string, rule_type string, rule_subtype string, rule_zone string, rule_level int, rule_list string, rule_list_level int, rule_flags array<string>"

# The domains of zones and block types, and the flags of a block.
ZONES = ["title_page", "control_sheet", "toc", "main_body", "appendix", "bibliography", "template_instruction", "a3_template_section", "footer_or_header", "unknown_zone"]
BLOCK_TYPES = [
    "title_meta", "toc_item", "heading", "appendix_heading", "paragraph", "list_item", "table", "table_label", "table_caption", "table_header_cell",
    "table_stub_cell", "table_body_cell", "figure", "figure_caption", "figure_explanation", "formula", "formula_number", "formula_explanation", "note_like",
    "note_label", "note_text", "template_instruction", "bibliography_item", "code_inline", "code_block", "empty", "unknown",
]
FLAGS = ["is_empty", "is_template_instruction", "is_deletable_template_content", "is_generated_toc_entry", "is_front_matter", "needs_review", "is_suspicious"]
LIST_TYPES = {"numbered": "numbered", "bulleted": "bulleted", "bulleted_dash": "bulleted", "lettered": "lettered", "unknown": "unknown"}


@dataclass(frozen=True)
class Lexicon:
    """Words of one language and template. All comparisons ignore case, but for letters of appendix numbers."""

    appendix: str
    table: str
    figure: str
    note: list[str]
    control: str
    control_styles: list[str]
    contents: str
    sources: str
    heading_styles: list[str]
    not_heading_styles: list[str]
    appendix_style: str
    title_styles: list[str]
    contents_styles: list[str]
    source_styles: list[str]
    note_label_style: str
    note_text_style: str
    markers: list[tuple[str, str]]
    subject_markers: list[str]
    conditions: list[str]
    evidence: list[str]
    process: list[str]
    templates: dict[str, str] = field(hash=False, default_factory=dict)


# Fixed values of the Russian quality-document template.
RUSSIAN = Lexicon(
    appendix="Приложение", table="таблица", figure="рисунок", note=["примечание", "note"], control="контрольный лист", control_styles=["структурный", "вне содержания"], contents="содержание", sources="библиография",
    heading_styles=["heading", "заголовок"], not_heading_styles=["таблиц", "рисунок", "оглавление"], appendix_style="прил", title_styles=["титуль", "title"],
    contents_styles=["оглавление", "содержание"], source_styles=["список источников", "библиограф"],
    note_label_style="05_ИЦЖТ_Примечание_слово", note_text_style="05_ИЦЖТ_Примечание_текст после",
    markers=[("должен", "obligation"), ("должна", "obligation"), ("должны", "obligation"), ("необходимо", "necessity"), ("следует", "recommendation"),
             ("подлежит", "obligation"), ("обязан", "obligation"), ("обязано", "obligation"), ("обязаны", "obligation")],
    subject_markers=["должен", "должна", "должны", "обязан", "обязана", "обязаны", "необходимо", "следует", "подлежит"],
    conditions=["если", "при", "в случае"],
    evidence=["зарегистр", "регистрац", "журнал", "запис", "документ", "оформл", "реестр"],
    process=["контрол", "проведен", "процесс", "обеспеч", "выполня", "организ", "провер"],
    templates={"evidence": "Как подтверждается %s?", "process": "Как обеспечивается %s?", "how": "Каким образом %s?", "done": "Каким образом выполняется %s?", "plain": "Как выполняется %s?"},
)

ENGLISH = Lexicon(
    appendix="Appendix", table="table", figure="figure", note=["note"], control="control sheet", control_styles=["structural", "not in contents"], contents="contents", sources="bibliography",
    heading_styles=["heading"], not_heading_styles=["table", "figure", "contents"], appendix_style="appendix", title_styles=["title"],
    contents_styles=["contents"], source_styles=["bibliography"], note_label_style="Note label", note_text_style="Note text",
    markers=[("with", "obligation"), ("that", "obligation"), ("from", "necessity"), ("by", "recommendation")],
    subject_markers=["with", "that", "from", "by"], conditions=["when", "if"], evidence=["tion", "ord"], process=["ing", "ent"],
    templates={"evidence": "How is it confirmed: %s?", "process": "How is it ensured: %s?", "how": "In what way %s?", "done": "In what way is it done: %s?", "plain": "How is it done: %s?"},
)

#: Styles of the text-line adapter.
LINE_STYLES = [
    ("Heading 1", "heading", "main_heading", "main_body", 1, None, None, []),
    ("Heading 2", "heading", "main_heading", "main_body", 2, None, None, []),
    ("Normal", "paragraph", "main_text", "main_body", None, None, None, []),
    ("List dash", "list_item", "bulleted_dash", "main_body", None, "bulleted_dash", 1, []),
    ("Note label", "note_like", "note_label", "main_body", None, None, None, []),
    ("Note text", "note_like", "note_text", "main_body", None, None, None, []),
    ("Table caption", "table_caption", "table_title", "main_body", None, None, None, []),
    ("Figure", "figure", "graphic_object", "main_body", None, None, None, []),
    ("For deletion", "template_instruction", "deletable", "template_instruction", None, None, None, ["is_template_instruction", "is_deletable_template_content"]),
]
#: Styles of the adapter of deep headings and front matter; its other styles have no rule.
DEEP_STYLES = [
    ("Normal", "paragraph", "main_text", "main_body", None, None, None, []),
    ("Cover", "paragraph", "cover_text", "title_page", None, None, None, ["is_front_matter"]),
    ("Meta", "title_meta", "title_page_meta", "main_body", None, None, None, ["is_front_matter"]),
]
#: Styles of the page adapter: the tag names of a page.
TAG_STYLES = [
    ("title", "title_meta", "title_page_meta", "title_page", None, None, None, ["is_front_matter"]),
    ("li", "toc_item", "toc_level_1", "toc", 1, None, None, ["is_generated_toc_entry"]),
    ("div", "template_instruction", "template_note", "template_instruction", None, None, None, ["is_template_instruction", "is_deletable_template_content"]),
    ("h1", "heading", "main_heading", "main_body", 1, None, None, []),
    ("p", "paragraph", "main_text", "main_body", None, None, None, []),
]


def style_rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A rule table; values outside the domains become unknown."""
    safe = [(r[0], r[1] if r[1] in BLOCK_TYPES else "unknown", r[2], r[3] if r[3] in ZONES else "unknown_zone", *r[4:7], [f for f in r[7] if f in FLAGS]) for r in rows]
    return spark.createDataFrame(safe, STYLE_SCHEMA)


def read_style_registry(path: str, check: Callable[[dict], list[str]] | None = None) -> list[tuple]:
    """Rule rows of a YAML registry (style_registry: name -> block_type, block_subtype, default_zone, ...).

    check tells what is wrong with the registry, if anything: that is an error.
    """
    import yaml

    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a registry is a mapping of keys")
    if check is not None and (wrong := check(found)):
        raise ValueError(f"{path}: " + "; ".join(wrong))
    found = found["style_registry"]
    return [
        (name, r["block_type"], r.get("block_subtype"), r.get("default_zone") or "unknown_zone", r.get("heading_level"), r.get("list_type"), r.get("list_level"), list(r.get("flags") or []))
        for name, r in found.items()
    ]

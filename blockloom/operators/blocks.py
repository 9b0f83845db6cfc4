"""From block rows to classified blocks: types, zones, sections, notes and review features.

All state is in windows over (document_id, block_order): one exchange and one sort serve every operator of this module.
A document's blocks meet in one task, as the order of a document asks for; documents spread by their id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import text as t
from ..sources.rules import FLAGS, LIST_TYPES, ZONES, Lexicon

NUMBER = r"[0-9]+(?:\.[0-9]+){0,5}"
LETTER = "[А-ЯA-Z]"
#: A letter for each zone, in maps of zones; the zones that a title page's style cannot leave.
LETTERS = [chr(ord("a") + i) for i in range(len(ZONES))]
BODY = ("control_sheet", "toc", "main_body", "appendix", "bibliography")


def in_order() -> WindowSpec:
    """A document's blocks in their order."""
    return Window.partitionBy("document_id").orderBy("block_order")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


class Shapes:
    """Predicates on a block's text and style for one lexicon."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex
        word = re.escape(lex.appendix)
        self.root = rf"(?iud)^\s*{word}\s+{LETTER}(?:\s*\([^)]*\))?(?:\s*[—:-]\s*.+|\s+.+)?$"
        self.root_letter = rf"(?iu)^\s*{word}\s+({LETTER})(?:{t.N}|$)"
        self.sub = rf"^\s*{LETTER}(?:\.[0-9]+){{1,5}}\s+.+$"

    def has(self, style: Column, parts: list[str]) -> Column:
        return self.among(t.folded(style), parts)

    def among(self, low: Column, parts: list[str]) -> Column:
        """Whether a folded style holds any of the parts."""
        out = F.lit(False)
        for part in parts:
            out = out | low.contains(part)
        return out

    def all_among(self, low: Column, parts: list[str]) -> Column:
        out = F.lit(bool(parts))
        for part in parts:
            out = out & low.contains(part)
        return out

    def heading_style(self, low: Column) -> Column:
        return self.among(low, self.lex.heading_styles) & ~self.among(low, self.lex.not_heading_styles)

    def appendix_text(self, text: Column) -> Column:
        return text.rlike(self.root) | text.rlike(self.sub)

    def heading_shape(self, text: Column) -> Column:
        """Short, unpunctuated, or numbered: what a heading-like style may call a heading."""
        words = t.word_total(text)
        plain = ~text.rlike(r"[.!?;:]$") & ~text.rlike("[,;]") & words.between(1, 8) & (F.length(text) <= 80)
        return self.appendix_text(text) | text.rlike(rf"^\s*{NUMBER}\s+.+$") | plain

    def appendix_shape(self, text: Column) -> Column:
        return text.rlike(self.sub) | (text.startswith("(") & (t.word_total(text) <= 8) & ~text.rlike(r"[.!?;:]$")) | self.heading_shape(text)


def classified(blocks: DataFrame, rules: DataFrame, lex: Lexicon) -> DataFrame:
    """Block rows with type, subtype, zone, heading and list fields, flags and section path."""
    shapes = Shapes(lex)
    base = blocks.withColumn("style", t.strip(F.coalesce("style", F.lit("")))).withColumn("norm", t.block_text(F.col("text")))
    base = base.withColumn("low_style", t.folded(F.col("style")))  # once per block, before the join keeps it so
    base = base.join(F.broadcast(rules), "style", "left")  # a rule table is a few rows per style of a template
    style, norm, low_style = F.col("style"), F.col("norm"), F.col("low_style")
    is_table, is_empty = F.col("kind") == "table", (F.col("kind") != "table") & (norm == "")

    by_style, appendix_style = shapes.heading_style(low_style), shapes.heading_style(low_style) & shapes.among(low_style, [lex.appendix_style])
    fixed = F.when(appendix_style | norm.rlike(shapes.root), "appendix_heading")
    inside = fixed.when(norm.rlike(shapes.sub) | (by_style & shapes.appendix_shape(norm)), "appendix_heading").when(by_style & shapes.heading_shape(norm), "heading")
    outside = fixed.when(by_style & shapes.heading_shape(norm), "heading")
    numbered = F.when(norm.rlike(rf"^\s*{NUMBER}\s+.+$"), "heading")
    known = F.col("rule_type").isNotNull()

    def kind_of(guess: Column) -> Column:
        return (
            F.when(known & F.col("rule_type").isin("paragraph", "heading"), F.coalesce(guess, F.col("rule_type")))
            .when(known, F.col("rule_type"))
            .otherwise(F.coalesce(guess, numbered, F.lit("paragraph")))
        )

    base = base.withColumns({"in_type": kind_of(inside), "out_type": kind_of(outside), "by_style": by_style, "known": known})
    out_type, low = F.col("out_type"), F.lower(norm)
    anchor = (
        F.when((low == lex.control) | (low.contains(lex.control) & shapes.all_among(low_style, lex.control_styles)), "control_sheet")
        .when((low == lex.contents) | shapes.among(low_style, lex.contents_styles) | (out_type == "toc_item"), "toc")
        .when((low == lex.sources) | shapes.among(low_style, lex.source_styles) | (out_type == "bibliography_item"), "bibliography")
        .when(out_type == "heading", "main_body")
    )
    # How a block changes the zone: 0 sets it, 1 unless in the appendix, 2 unless in the appendix, control sheet or
    # bibliography, 3 unless on the title page, too (what belongs there, or has no style); 4 leaves it.
    always = (out_type == "appendix_heading") | shapes.appendix_text(norm)
    default = F.when(F.col("known"), F.col("rule_zone")).otherwise(F.lit("main_body"))
    power = (
        F.when(is_table | is_empty, 4).when(always, 0).when(anchor.isNotNull() & (F.col("in_type") == "appendix_heading"), 1).when(anchor.isNotNull(), 0)
        .when(default == "unknown_zone", 4).when((out_type == "title_meta") | ((default == "main_body") & (style == "")), 3).otherwise(2)
    )
    base = base.withColumn("power", power).withColumn("to_zone", F.when(always, F.lit("appendix")).otherwise(F.coalesce(anchor, default)))
    # A title page's style leads to the title page from wherever the body has not begun, but has no say elsewhere.
    titled = shapes.among(low_style, lex.title_styles) & ~is_table & ~is_empty & ~always & F.coalesce(anchor == "main_body", F.lit(True))
    base = zones(base.withColumn("titled", titled).drop("low_style"))

    before = F.col("zone_before")
    kind = F.when(is_table, "table").when(is_empty, "empty").when(before == "appendix", F.col("in_type")).otherwise(F.col("out_type"))
    zone = (
        F.when(is_table, before)
        .when(is_empty, F.when(before.isin("title_page", "control_sheet", "toc"), before).otherwise("unknown_zone"))
        .otherwise(F.col("zone_after"))
    )
    base = base.withColumns({"block_type": kind, "zone": zone, "is_empty": is_empty})
    plain = ~is_table & ~is_empty
    guessed = plain & ~F.col("known")
    headed = F.col("block_type").isin("heading", "appendix_heading")
    subtype = (
        F.when(plain & F.col("known"), F.col("rule_subtype")).when(guessed & (F.col("block_type") == "appendix_heading"), "appendix_heading_fallback")
        .when(guessed & headed & F.col("by_style"), "style_heading_fallback").when(guessed & headed, "numbered_heading_fallback").when(guessed, "plain_paragraph_fallback")
    )
    method = F.when(headed & F.col("known"), "style_registry").when(headed & F.col("by_style"), "style_fallback").when(headed, "text_fallback")
    base = base.withColumns({
        "block_subtype": subtype, "method": method, "confidence": F.when(headed, F.when(F.col("known"), 0.99).otherwise(0.75)),
        "heading_number": F.when(headed, heading_number(shapes)), "heading_title": F.when(headed, heading_title(shapes)),
        "list_type": F.when((F.col("block_type") == "list_item") & F.col("known"), list_type(F.col("rule_list"))),
        "list_mark": F.when((F.col("block_type") == "list_item") & F.col("known"), t.list_marker(norm)),
        "flags": F.when(is_empty, F.array(F.lit("is_empty"))).when(guessed, F.array(F.lit("needs_review"), F.lit("is_suspicious")))
        .otherwise(F.coalesce(F.filter("rule_flags", lambda f: f.isin(*FLAGS)), F.array().cast("array<string>"))),
    })
    base = base.withColumn("heading_level", F.when(headed, heading_level(shapes)))
    return sections(base, shapes)


def list_type(rule: Column) -> Column:
    out = F.when(rule.isNull() | (rule == ""), F.lit(None).cast("string"))
    for name, to in LIST_TYPES.items():
        out = out.when(rule == name, to)
    return out.otherwise("unknown")


def zone_map(titled: Column) -> Column:
    """What a block makes of each zone, as a string: the letter of the zone that follows on the zone of that place.

    A block keeps the zones that its power names and turns the others into to_zone; titled blocks turn what is not yet
    the document's body into the title page.
    """
    target = F.element_at(F.create_map(*[F.lit(x) for z in ZONES for x in (z, LETTERS[ZONES.index(z)])]), F.col("to_zone"))
    keeps = {"appendix": 1, "control_sheet": 2, "bibliography": 2, "title_page": 3}
    out = []
    for letter, zone in zip(LETTERS, ZONES, strict=True):
        after = F.when(F.col("power") >= keeps.get(zone, 4), letter).otherwise(target)
        out.append(after if zone in BODY else F.when(titled, LETTERS[ZONES.index("title_page")]).otherwise(after))
    return F.concat(*out)


def zones(base: DataFrame) -> DataFrame:
    """zone_before and zone_after of each block, from power, to_zone and titled.

    Each block is a map of zones to zones, and maps compose. A block whose map has one value sets the zone whatever it was
    before, and so begins a run; in a run, maps are applied in turn to the zone that it begins with. Only blocks whose map
    differs from the map before them count: a map that leads to what it keeps does nothing more when it is repeated.
    """
    first, whole = LETTERS[ZONES.index("title_page")], "".join(LETTERS)
    base = base.withColumn("map", zone_map(F.col("titled"))).drop("titled")
    sets = F.col("map") == F.repeat(F.substring("map", 1, 1), F.lit(len(ZONES)))
    acts = F.when(F.col("map") != whole, F.col("map"))
    base = base.withColumns({
        "run": F.sum(sets.cast("int")).over(so_far()), "begin": F.coalesce(F.last(F.when(sets, F.substring("map", 1, 1)), ignorenulls=True).over(so_far()), F.lit(first)),
        "acted": F.last(acts, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1)),
    })
    lasting = F.col("map") == F.expr(f"translate(map, '{whole}', map)")
    event = F.when(~sets & ~(lasting & F.coalesce(F.col("map") == F.col("acted"), F.lit(False))), acts)
    in_run = Window.partitionBy("document_id", "run").orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("events", F.collect_list(event).over(in_run))
    after = F.aggregate("events", F.col("begin"), lambda zone, m: F.substr(m, F.instr(F.lit(whole), zone), F.lit(1)))
    named = F.create_map(*[F.lit(x) for pair in zip(LETTERS, ZONES, strict=True) for x in pair])
    base = base.withColumn("zone_after", F.element_at(named, after)).drop("map", "run", "begin", "acted", "events")
    return base.withColumn("zone_before", F.coalesce(F.lag("zone_after").over(in_order()), F.lit("title_page")))


def heading_number(shapes: Shapes) -> Column:
    norm = F.col("norm")
    plain = t.group(norm, rf"^\s*({NUMBER})(?:{t.N}|$)")
    appendix = F.coalesce(F.upper(t.group(norm, shapes.root_letter)), t.group(norm, rf"^\s*({LETTER}(?:\.[0-9]+){{0,5}})(?:{t.N}|$)"), plain)
    return F.when(F.col("block_type") == "appendix_heading", appendix).otherwise(plain)


def heading_title(shapes: Shapes) -> Column:
    norm = F.col("norm")
    root = rf"(?iu)^\s*{re.escape(shapes.lex.appendix)}\s+{LETTER}\s*(.+)?$"
    plain = F.coalesce(t.group(norm, rf"^\s*{NUMBER}\s+(.+)$"), norm)
    appendix = F.when(norm.rlike(root), F.coalesce(t.null_if_empty(t.strip(F.regexp_extract(norm, root, 1), r" .:\-")), norm)).otherwise(
        F.coalesce(t.group(norm, rf"^\s*{LETTER}(?:\.[0-9]+){{0,5}}\s+(.+)$"), plain)
    )
    return t.strip(F.when(F.col("block_type") == "appendix_heading", appendix).otherwise(plain))


def heading_level(shapes: Shapes) -> Column:
    words = "|".join(shapes.lex.heading_styles)
    rule = F.when(F.col("known"), F.col("rule_level"))
    style = F.expr(r"try_cast(regexp_extract(style, '(?iu)(?:^|\\s)(?:" + words + r")\\s*([0-9]+)(?:[^\\p{L}\\p{N}_]|$)', 1) AS int)")
    inferred = F.size(F.split("heading_number", r"\."))
    inferred = F.when(F.col("heading_number").isNotNull(), inferred)
    appendix = F.coalesce(inferred, F.when(rule.isNotNull(), F.greatest(rule, F.lit(2))), F.greatest(style, F.lit(2)))
    return F.when(F.col("block_type") == "appendix_heading", appendix).otherwise(F.coalesce(rule, style, inferred, F.lit(1)))


def sections(base: DataFrame, shapes: Shapes) -> DataFrame:
    """section_path: ids of the open sections, from headings that no later heading of their level or above has closed.

    Main body and appendix have stacks of their own, of any depth. A heading whose level no earlier one is below closes all
    sections, and so begins a run; the stack of a heading is folded from the headings of its run, and holds until the next.
    """
    norm, order = F.col("norm"), F.col("block_order").cast("string")
    main = (F.col("block_type") == "heading") & (F.col("zone") == "main_body")
    other = (F.col("block_type") == "appendix_heading") & (F.col("zone") == "appendix")
    case = rf"^\s*{re.escape(shapes.lex.appendix)}\s+({LETTER})(?:{t.N}|$)"
    own = rf"^\s*({LETTER}(?:\.[0-9]+){{0,5}})(?:{t.N}|$)"
    section = F.when(main, F.coalesce(F.col("heading_number"), F.concat(F.lit("UNNUMBERED_"), order))).when(
        other, F.coalesce(t.group(norm, case), t.group(norm, own), F.col("heading_number"), F.concat(F.lit("APP_UNNUMBERED_"), order))
    )
    level = F.when(F.coalesce(F.col("heading_level"), F.lit(0)) == 0, 1).otherwise(F.col("heading_level"))
    node = F.when(main | other, F.struct(level.alias("level"), section.alias("id"), F.coalesce("heading_title", "norm").alias("title")))
    in_zone = Window.partitionBy("document_id", "zone").orderBy("block_order")
    upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    base = base.withColumn("node", node).withColumn("lowest", F.min("node.level").over(upto(in_zone, -1)))
    begins = F.col("node").isNotNull() & (F.col("lowest").isNull() | (F.col("node.level") <= F.col("lowest")))
    base = base.withColumn("run", F.sum(begins.cast("int")).over(upto(in_zone, 0)))
    in_run = upto(Window.partitionBy("document_id", "zone", "run").orderBy("block_order"), 0)
    base = base.withColumn("opened", F.collect_list("node").over(in_run))
    none = F.array().cast("array<struct<level:int,id:string,title:string>>")
    folded = F.aggregate("opened", none, lambda stack, h: F.concat(F.filter(stack, lambda x: x["level"] < h["level"]), F.array(h)))
    base = base.withColumn("folded", F.when(F.col("node").isNotNull(), folded))
    base = base.withColumn("stack", F.last("folded", ignorenulls=True).over(in_run))
    path = F.coalesce(F.transform("stack", lambda m: m["id"]), F.array().cast("array<string>"))
    base = base.withColumn("section_path", path)
    top = F.try_element_at("stack", F.lit(-1))
    return base.withColumns({"section_id": top["id"], "section_title": top["title"], "section_level": top["level"], "parent_section": F.get("section_path", F.size("section_path") - 2)}).drop(
        "node", "lowest", "run", "opened", "folded", "stack"
    )


def with_notes(base: DataFrame, lex: Lexicon) -> DataFrame:
    """Note labels paired with the text that follows in the same zone; ids run on from the largest that exists."""
    style = F.col("style")
    note = (
        F.when(style == lex.note_label_style, "note_label").when(style == lex.note_text_style, "note_text")
        .when(F.col("block_subtype").isin("note_label", "note_text"), F.col("block_subtype")).when(F.col("block_type").isin("note_label", "note_text"), F.col("block_type"))
    )
    note = F.when(F.col("kind") != "table", note)
    if "old_group" not in base.columns:
        base = base.withColumn("old_group", F.lit(None).cast("string"))
    base = base.withColumn("note", note)
    starts = (F.col("note") == "note_label") & (F.lead("note").over(in_order()) == "note_text") & (F.lead("zone").over(in_order()) == F.col("zone"))
    base = base.withColumn("starts", F.coalesce(starts, F.lit(False)))
    shared = t.null_if_empty(F.col("old_group"))
    shared = F.when(F.col("starts") & (shared == t.null_if_empty(F.lead("old_group").over(in_order()))), shared)
    base = base.withColumn("shared", shared).withColumn("ends", F.coalesce(F.lag("starts").over(in_order()), F.lit(False)))
    largest = F.max(F.expr("try_cast(regexp_extract(old_group, '^note_group_([0-9]+)$', 1) AS int)")).over(Window.partitionBy("document_id"))
    fresh = F.sum(F.when(F.col("starts") & F.col("shared").isNull(), 1).otherwise(0)).over(so_far())
    number = F.coalesce(F.col("shared"), F.format_string("note_group_%04d", (F.coalesce(largest, F.lit(0)) + fresh).cast("long")))
    base = base.withColumn("group_here", F.when(F.col("starts"), number))
    base = base.withColumn("note_group", F.when(F.col("ends"), F.lag("group_here").over(in_order())).otherwise(F.col("group_here")))
    orphan = F.when(F.col("note").isNotNull(), ~(F.col("starts") | F.col("ends")))
    role = F.when(F.col("note") == "note_label", "label").when(F.col("note") == "note_text", "text")
    base = base.withColumns({"is_orphan": orphan, "note_role": role, "block_type": F.coalesce("note", "block_type")})
    return base.drop("note", "starts", "ends", "shared", "group_here", "old_group")


def with_features(base: DataFrame, lex: Lexicon) -> DataFrame:
    """Review features, links to neighbours and reason codes; wants with_notes() first, which changes types."""
    norm = F.col("norm")
    empty = (F.col("block_type") == "empty") | F.array_contains("flags", "is_empty") | ((norm == "") & (F.col("kind") != "table"))
    marker = lambda words: norm.rlike(rf"(?iu)^\s*(?:{'|'.join(words)})(?:{t.N}|$)")
    source = F.when(F.col("method") == "style_registry", "registry").when(F.col("method").contains("fallback"), "fallback").when(F.col("method").isNotNull(), "heuristic")
    base = base.withColumn("artifact", empty).withColumns({
        "block_id": F.format_string("b%06d", F.col("block_order")), "compact_path": t.joined(F.col("section_path")), "source": source,
        "ends_with_colon": norm.endswith(":"), "like_table": marker([lex.table]), "like_figure": marker([lex.figure]), "like_note": marker(lex.note),
        # Without regard to case in the first word only where it is written small: capitals are another reason's matter.
        "like_appendix": norm.rlike(rf"^\s*(?:{re.escape(lex.appendix.lower())}\s+{LETTER}|{LETTER}(?:\.[0-9]+){{1,5}})(?:{t.N}|$)"),
    })
    ahead = in_order().rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(~F.col("artifact"), F.col("block_type")), ignorenulls=True).over(ahead)
    base = base.withColumns({
        "prev_id": F.lag("block_id").over(in_order()), "next_id": F.lead("block_id").over(in_order()), "prev_type": F.lag("block_type").over(in_order()), "next_type": F.lead("block_type").over(in_order()),
        "list_follows": F.coalesce(following == "list_item", F.lit(False)),
    })
    heading = F.col("block_type").isin("heading", "appendix_heading")
    between = F.concat_ws(">", "prev_type", "next_type").isin("table_caption>table", "note_label>note_text", "figure_caption>figure")
    noted = F.col("block_type").isin("note_label", "note_text", "note_like")
    codes = [
        (heading & (F.array_contains("flags", "needs_review") | F.array_contains("flags", "is_suspicious")), "suspicious_heading"),
        (heading & (F.col("source") == "fallback"), "fallback_heading"),
        (heading & F.col("ends_with_colon") & F.col("list_follows"), "heading_with_colon_before_list"),
        ((F.col("block_type") == "figure") & F.col("like_table"), "figure_text_looks_like_table"),
        (noted & F.coalesce("is_orphan", F.lit(False)), "orphan_note"),
        ((F.col("block_type") == "note_like") & ~F.coalesce("is_orphan", F.lit(False)) & F.col("like_note"), "note_anchor_ambiguity"),
        (F.col("like_appendix") & (F.col("block_type") != "appendix_heading"), "appendix_like_non_appendix_block"),
        (F.col("artifact") & F.col("prev_id").isNotNull() & F.col("next_id").isNotNull() & between, "layout_artifact_between_related_blocks"),
    ]
    return base.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in codes])))


def analysed(blocks: DataFrame, rules: DataFrame, lex: Lexicon) -> DataFrame:
    return with_features(with_notes(classified(blocks, rules, lex), lex), lex)


def review_candidates(base: DataFrame) -> DataFrame:
    """Blocks with reasons, numbered, with up to two neighbours on either side."""
    near = F.struct("block_id", "block_type", "zone", t.preview(F.col("norm")).alias("preview"), "section_path")
    base = base.withColumns({"before": F.collect_list(near).over(in_order().rowsBetween(-2, -1)), "after": F.collect_list(near).over(in_order().rowsBetween(1, 2)), "current": near})
    kept = base.filter(F.size("reasons") > 0)
    label = F.coalesce("block_subtype", "block_type")
    return kept.select("document_id", F.format_string("rc_%04d", F.row_number().over(in_order())).alias("candidate_id"), "block_id", label.alias("label"), "block_type", "reasons", "before", "current", "after",
                       "compact_path", "source", "ends_with_colon", "like_table", "like_figure", "like_appendix", "like_note", "artifact", "list_follows")


def logical_notes() -> Column:
    """Pairs count once, orphans and ungrouped notes each."""
    half, group = F.col("block_type").isin("note_label", "note_text"), t.null_if_empty(F.col("note_group"))
    return F.count_distinct(F.when(half, group)) + F.count_if(half & group.isNull()) + F.count_if(F.col("block_type") == "note_like")


COUNTED = {
    "total_tables": "table", "total_list_items": "list_item", "total_template_instructions": "template_instruction", "total_sections": "heading",
    "total_appendix_sections": "appendix_heading", "total_figures": "figure", "total_formulas": "formula",
}


def structure_summary(base: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("block_type") == kind).alias(name) for name, kind in COUNTED.items()]
    return base.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_blocks"), *counts, logical_notes().alias("total_notes"))


def used_styles(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id").agg(F.array_sort(F.collect_set(t.null_if_empty(t.strip(F.col("style"))))).alias("styles"))

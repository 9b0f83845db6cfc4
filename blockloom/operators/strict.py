"""Strict reading of JSON: every key is checked for its presence, its type and its domain, and bad inputs give error rows.

A shape says what an object may hold. Each text is parsed once into a variant, and all its problems are one array beside
it, so a text is read once however many objects its shape has, and one bad document doesn't end the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.rules import BLOCK_TYPES, FLAGS, ZONES
from . import render

#: What a variant of each kind says of its own type; null is a value of every kind that is not required.
KINDS = {
    "string": "STRING", "int": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "strings": "ARRAY<(?:STRING|VOID)>", "rows": "ARRAY<.*>", "object": "OBJECT<.*>", "any": ".*",
}


@dataclass(frozen=True)
class Key:
    """A key of an object. own: the shape of an object; each: that of a list's or an object's members, which may have more
    keys if `more`; domain: the values that strings may have."""

    kind: str
    required: bool = False
    domain: tuple[str, ...] | None = None
    own: dict[str, Key] | None = field(default=None, hash=False)
    each: dict[str, Key] | None = field(default=None, hash=False)
    more: bool = False


KIND_OF = {"string": "string", "long": "int", "int": "int", "boolean": "boolean", "array<string>": "strings", "array<array<string>>": "rows"}
BLOCK = {
    **{name: Key("string") for name in render.FIELDS}, **{name: Key(KIND_OF[kind]) for name, kind in render.MORE.items()},
    "block_id": Key("string", True), "block_order": Key("int", True), "zone": Key("string", True, tuple(ZONES)), "block_type": Key("string", True, tuple(BLOCK_TYPES)),
    "section_path": Key("strings"), "reasons": Key("strings"), "flags": Key("strings", domain=tuple(FLAGS)),
}
DOCUMENT = {
    "document_id": Key("any", True), "blocks": Key("rows", True, each=BLOCK), "styles": Key("strings"), "summary": Key("object", own={c: Key("int", True) for c in render.COUNTERS}),
    "source": Key("object", own={"path": Key("string", True), "template_id": Key("string")}),
}
RULE = {
    "block_type": Key("string", True), "block_subtype": Key("string"), "default_zone": Key("string"), "heading_level": Key("int"), "list_type": Key("string"), "list_level": Key("int"),
    "semantic_hints": Key("strings"), "flags": Key("strings"),
}
ZONE_RULE = {"name": Key("string", True), "assign_zone": Key("string", True), **{x: Key("strings") for x in ("when_styles", "when_text_equals", "when_text_contains", "preferred_styles")}}
SETTINGS = {"classification_mode": Key("string"), **{x: Key("boolean") for x in ("fallback_to_text_patterns", "detect_document_zones", "keep_unknown_styles", "collect_header_footer", "build_composite_objects")}}
FALLBACKS = {f"{x}_pattern": Key("string") for x in ("heading_number", "appendix_heading", "numbered_list", "lettered_list", "bulleted_list", "note")}
#: The keys of a style registry. Rules of styles may have keys beside these; types and zones outside the
#: domains are no problem, but read as unknown.
REGISTRY = {
    "template_id": Key("string", True), "version": Key("string", True), "description": Key("string"), "settings": Key("object", True, own=SETTINGS), "document_zones": Key("strings", True),
    "block_types": Key("strings", True), "style_registry": Key("object", True, each=RULE, more=True), "zone_detection_rules": Key("rows", each=ZONE_RULE), "fallback_rules": Key("object", own=FALLBACKS),
    "composite_object_rules": Key("object", own={x: Key("object") for x in ("table", "figure", "formula", "note")}),
}


FOUND = "array<struct<path:string,problem:string>>"


def problems(frame: DataFrame, shape: dict[str, Key], column: str = "json") -> DataFrame:
    """name, path, problem of everything in the texts of rows name, json that the shape doesn't allow."""
    return frame.select("name", F.explode(problem_list(F.col(column), shape)).alias("found")).select("name", "found.*")


def problem_list(text: Column, shape: dict[str, Key]) -> Column:
    """The problems of one text, as an array of path and problem."""

    def of_text(v: Column) -> Column:
        return F.when(_members(v).isNull(), F.array(_problem(F.lit(""), F.lit("not a JSON object")))).otherwise(_in_object(v, F.lit(""), shape))

    return t.let(F.try_parse_json(text), of_text)


def _problem(path: Column, problem: Column) -> Column:
    return F.struct(path.alias("path"), problem.alias("problem"))


def _members(v: Column) -> Column:
    """Key and value of each member of an object; null of what is none."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _at(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _in_object(v: Column, path: Column, shape: dict[str, Key], more: bool = False) -> Column:
    """The problems of an object v at path, and of what it holds."""
    entries = F.transform(_members(v), lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("kind"), e["value"].alias("v")))
    return t.let(entries, lambda found: _in_entries(found, path, shape, more))


def _in_entries(found: Column, path: Column, shape: dict[str, Key], more: bool) -> Column:
    required = [name for name, k in shape.items() if k.required]
    no_path = F.array().cast(FOUND)

    def own(e: Column) -> Column:
        """What is wrong with one entry itself: its key, its type or its value."""
        key, kind = e["key"], e["kind"]
        wrong = F.lit(False)
        for name in dict.fromkeys(k.kind for k in shape.values()):
            here = [n for n, k in shape.items() if k.kind == name]
            wrong = F.when(key.isin(*here), ~kind.rlike(f"^(?:{KINDS[name]})$")).otherwise(wrong)
        wrong = wrong & ((kind != "VOID") | key.isin(*required))
        problem = F.when(~key.isin(*shape), F.lit(None if more else "unknown key").cast("string")).when(wrong, F.concat(F.lit("wrong type: "), kind))
        for name, k in shape.items():
            if k.domain and k.kind == "string":
                problem = problem.when((key == name) & ~F.try_variant_get(e["v"], "$", "string").isin(*k.domain), "unknown value")
            elif k.domain:
                known = F.array(*[F.lit(x) for x in k.domain])
                problem = problem.when((key == name) & (F.size(F.array_except(F.try_variant_get(e["v"], "$", "array<string>"), known)) > 0), "unknown value")
        return _problem(_at(path, key), problem)

    parts = [F.filter(F.transform(found, own), lambda p: p["problem"].isNotNull())]
    if required:
        lacking = F.array_except(F.array(*[F.lit(x) for x in required]), F.transform(found, lambda e: e["key"]))
        parts.append(F.transform(lacking, lambda name: _problem(_at(path, name), F.lit("missing key"))))
    for name, k in shape.items():
        if k.each is not None:
            parts.append(_within(found, "^(?:ARRAY|OBJECT)", name, lambda v, at, k=k: _in_members(v, at, k), path))
        if k.own is not None:
            parts.append(_within(found, "^OBJECT", name, lambda v, at, k=k: _in_object(v, at, k.own), path))
    return F.concat(no_path, *parts)


def _within(found: Column, kinds: str, name: str, look: Callable[[Column, Column], Column], path: Column) -> Column:
    """What look finds in the value of a key, if it is of one of the kinds."""
    held = F.filter(found, lambda e: (e["key"] == name) & e["kind"].rlike(kinds))
    return F.flatten(F.transform(held, lambda e: look(e["v"], _at(path, e["key"]))))


def _in_members(v: Column, path: Column, k: Key) -> Column:
    """The problems of the members of a list or an object v, each of which is an object of the shape of k."""

    def member(value: Column, at: Column) -> Column:
        none = F.array(_problem(at, F.concat(F.lit("wrong type: "), F.schema_of_variant(value))))
        return F.when(_members(value).isNull(), none).otherwise(_in_object(value, at, k.each, k.more))

    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: member(x, F.concat(path, F.format_string("[%d]", i))))
    named = F.transform(_members(v), lambda e: member(e["value"], F.concat(path, F.lit("."), e["key"])))
    return F.flatten(F.coalesce(listed, named))


def read_documents(frame: DataFrame, id_type: str = "long") -> tuple[DataFrame, DataFrame]:
    """Block rows of the documents without problems, and the problems (name, path, problem) of the others, of rows name, json.

    Each is one pass over the texts, without a join: a text's problems stand beside it.
    """
    good = frame.filter(F.size(problem_list(F.col("json"), DOCUMENT)) == 0)
    return render.read_document_json(good, id_type), problems(frame, DOCUMENT)


def registry_problems(spark: SparkSession, registry: dict, name: str = "registry") -> DataFrame:
    """The problems of a style registry as it was read from YAML."""
    return problems(spark.createDataFrame([(name, json.dumps(registry))], "name string, json string"), REGISTRY)

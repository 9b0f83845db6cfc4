"""Entry points over files: what a user calls for a folder of word documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, render, strict, tables, validate
from .operators import requirements as R
from .sources import docx, rules, sinks


def read_registry(spark: SparkSession, path: str) -> list[tuple]:
    """Rule rows of a YAML style registry; one with unknown or missing keys or wrong types is an error that names them."""
    check = lambda found: [f"{r.path}: {r.problem}" for r in strict.registry_problems(spark, found).orderBy("path").collect()]
    return rules.read_style_registry(path, check)


def parse_documents(spark: SparkSession, path: str, registry: str | None = None, lex: rules.Lexicon = rules.RUSSIAN) -> DataFrame:
    """Analysed blocks of every word file under path; registry is a YAML style registry."""
    table = rules.style_rules(spark, read_registry(spark, registry) if registry else rules.LINE_STYLES)
    files = docx.read_docx(spark, path)
    base = blocks.analysed(with_tables(docx.block_rows(files), docx.cell_rows(files)), table, lex)
    return with_list_formatting(base)


def with_list_formatting(base: DataFrame) -> DataFrame:
    """Blocks with list_formatting: id, level, marker and numbering style of list items, null for others."""
    level = F.coalesce(F.col("rule_list_level"), F.lit(0))
    return base.withColumn("list_formatting", docx.list_formatting(F.col("block_type"), F.col("list_type"), F.col("list_mark"), F.col("text"), F.col("block_id"), level))


def with_tables(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Block rows with table_id, table_rows, table_cols and cells (rows of texts) of their tables."""
    grids = tables.grid(cells).select(F.col("document_id").alias("key"), "rows_count", "cols_count", "cells")
    name = F.format_string("tbl_%04d", F.col("table_index"))
    is_table = F.col("table_index").isNotNull()
    joined = rows.withColumn("table_id", F.when(is_table, name)).join(grids, F.concat_ws("#", rows["document_id"], name) == grids["key"], "left").drop("key")
    size = {f"table_{x}": F.when(is_table, F.coalesce(f"{x}_count", F.lit(0))).cast("long") for x in ("rows", "cols")}
    return joined.withColumns(size).drop("rows_count", "cols_count")


def parse_table(spark: SparkSession, path: str, table_index: int) -> DataFrame:
    """One row per grid position of a table of each word file under path, with the spans of the cells that start there."""
    cells = docx.cell_rows(docx.read_docx(spark, path)).filter(F.col("table_index") == table_index)
    return tables.grid_cells(cells)


def table_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell of all tables under path: position, spans, text, style, alignment and table style."""
    return tables.spans(docx.cell_rows(docx.read_docx(spark, path)), ["document", "table_index", "style", "alignment", "vertical", "table_style"])


def requirement_records(base: DataFrame, lex: rules.Lexicon = rules.RUSSIAN) -> DataFrame:
    return R.records(R.candidates(base, lex), lex)


def apply_reviews(records: DataFrame, lex: rules.Lexicon = rules.RUSSIAN, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Applied records and log; without decisions the deterministic reviewer makes them."""
    return R.apply_baseline(records, lex) if decisions is None else R.apply_decisions(records, decisions, lex)


def audit_questions(applied: DataFrame, lex: rules.Lexicon = rules.RUSSIAN) -> DataFrame:
    return R.questions(R.question_rows(applied, lex))


def validate_documents(base: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """A report per document; documents (document_id) names those that may have no blocks."""
    return validate.report(validate.run_checks(base, documents))


def validate_folder(spark: SparkSession, path: str, registry: str | None = None, lex: rules.Lexicon = rules.RUSSIAN) -> DataFrame:
    """Reports of all word files under path; a file without blocks, or that can't be read, fails."""
    files = docx.read_docx(spark, path).select(F.col("path").alias("document_id"))
    return validate_documents(parse_documents(spark, path, registry, lex), files)


def validate_inputs(spark: SparkSession, inputs: list[str], registry: str | None = None, lex: rules.Lexicon = rules.RUSSIAN) -> tuple[DataFrame, DataFrame]:
    """Checks of the word files among files and folders, and the batch counters, which count missing and other inputs, too."""
    good, issues = validate.discover(validate.list_inputs(spark, inputs))
    there = [full for full, exists, _ in validate.resolve(spark, inputs) if exists]
    files = docx.read_docx(spark, there) if there else spark.createDataFrame([], docx.SCHEMA)
    files = files.join(good.withColumnRenamed("path", "input"), validate.one_name(F.col("path")) == F.col("input"), "left_semi")
    table = rules.style_rules(spark, read_registry(spark, registry) if registry else rules.LINE_STYLES)
    base = blocks.analysed(with_tables(docx.block_rows(files), docx.cell_rows(files)), table, lex)
    checks = validate.run_checks(base, files.select(F.col("path").alias("document_id")))
    return checks, validate.batch(checks, issues)


def export_review(base: DataFrame, path: str) -> None:
    """Review documents as rows of document_id and word-file bytes."""
    sinks.review_files(base).write.parquet(path)


def export_review_json(spark: SparkSession, source: str, path: str, id_type: str = "string") -> None:
    """Review documents from stored JSON documents (sinks.write_documents)."""
    export_review(render.read_document_json(spark.read.text(source).withColumnRenamed("value", "json"), id_type), path)

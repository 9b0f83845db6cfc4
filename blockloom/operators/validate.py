"""Integrity checks of analysed documents, one row per document and check, and their batch aggregate.

A check is data: what it says, and how a block, or a document, offends. All checks of a run are folded into one
aggregation, so a caller's own check costs no further pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rules import BLOCK_TYPES, ZONES
from .blocks import COUNTED, in_order, logical_notes

NOTES = ["note_label", "note_text", "note_like"]


@dataclass(frozen=True)
class Check:
    """blocks(base) tells of each block whether it offends; else document() gives the issues and offending names of a
    document, from the columns of the aggregation: total_blocks, differing (counters) and lost (candidates)."""

    name: str
    passed: str
    failed: str
    blocks: Callable[[DataFrame], Column] | None = None
    document: Callable[[], tuple[Column, Column]] | None = None


def _column(base: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in base.columns else F.lit(None).cast(kind)


def t_empty(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def _strings() -> Column:
    return F.array().cast("array<string>")


def unknown_values(base: DataFrame) -> Column:
    return ~F.coalesce(F.col("block_type").isin(*BLOCK_TYPES) & F.col("zone").isin(*ZONES), F.lit(False))


def wrong_links(base: DataFrame) -> Column:
    """Stored links against the neighbours as they are (real_prev, real_next)."""
    return ~(F.col("prev_id").eqNullSafe(F.col("real_prev")) & F.col("next_id").eqNullSafe(F.col("real_next")))


def no_payload(base: DataFrame) -> Column:
    rows, cols = (_column(base, x, "long") for x in ("table_rows", "table_cols"))
    return (F.col("block_type") == "table") & (rows.isNull() | cols.isNull())


def unready_note(base: DataFrame) -> Column:
    return F.col("block_type").isin(*NOTES) & F.col("list_follows").isNull()


def wrong_section(base: DataFrame) -> Column:
    kind = F.col("block_type")
    scope = kind.isin("heading", "appendix_heading", "paragraph", "list_item", "table") & F.col("zone").isin("main_body", "appendix")
    no_id = kind.isin("heading", "appendix_heading") & t_empty(F.col("section_id"))
    tail = (F.size("section_path") > 0) & ~t_empty(F.col("section_id")) & (F.try_element_at("section_path", F.lit(-1)) != F.col("section_id"))
    return scope & (no_id | F.coalesce(tail, F.lit(False)))


def no_candidate(base: DataFrame) -> Column:
    """A block with reasons that lacks what a candidate is made of."""
    return (F.size("reasons") > 0) & (F.col("block_id").isNull() | F.col("block_type").isNull() | F.col("zone").isNull())


def no_blocks() -> tuple[Column, Column]:
    return F.when(F.coalesce(F.col("total_blocks"), F.lit(0)) == 0, 1).otherwise(0), _strings()


CHECKS = [
    Check("non_empty_document", "The document has blocks.", "The document has no blocks.", document=no_blocks),
    Check("structure_summary_consistency", "The counters of the summary equal a recount.", "Counters of the summary differ from a recount.", document=lambda: (F.size("differing"), F.col("differing"))),
    Check("enum_domain_validity", "Block types and zones are known.", "Some block types or zones are unknown.", unknown_values),
    Check("adjacent_block_links", "Links to neighbours are right.", "Some links to neighbours are wrong.", wrong_links),
    Check("table_block_payloads", "Tables have their payload.", "Some tables lack a payload or a part of it.", no_payload),
    Check("note_block_review_readiness", "Notes have review features.", "Some notes have no review features.", unready_note),
    Check("section_context_validity", "Section ids and paths agree.", "Some blocks have no section id, or a path that ends elsewhere.", wrong_section),
    Check("review_candidates_build", "Review candidates can be built.", "Review candidates cannot be built.", no_candidate),
    Check("review_candidates_links", "Review candidates name blocks of the document.", "Some review candidates name blocks that the document does not have.", document=lambda: (F.size("lost"), F.col("lost"))),
]
#: What a check says where it passes and where it fails.
MESSAGES = {c.name: (c.passed, c.failed) for c in CHECKS}


def run_checks(base: DataFrame, documents: DataFrame | None = None, candidates: DataFrame | None = None, summary: DataFrame | None = None, checks: list[Check] = CHECKS) -> DataFrame:
    """document_id, name, status, issues, message, offending (block or candidate ids, counters' names) of every check.

    All checks are counts of one aggregation. documents (document_id) names documents that may have no blocks; candidates
    (document_id, candidate_id, block_id) and summary are stored ones to be checked. Without candidates those that base
    gives are meant, which name its own blocks; without a summary, the counters of base.
    """
    neighbours = base.withColumns({"real_prev": F.lag("block_id").over(in_order()), "real_next": F.lead("block_id").over(in_order())})
    by_block = {c.name: c.blocks(base) for c in checks if c.blocks is not None}
    block = F.struct("block_order", "block_id")
    listed = [F.transform(F.array_sort(F.collect_list(F.when(bad, block))), lambda b: b["block_id"]).alias(f"ids_{name}") for name, bad in by_block.items()]
    counts = [F.count_if(bad).alias(f"n_{name}") for name, bad in by_block.items()]
    actual = {"total_blocks": F.count(F.lit(1)), **{n: F.count_if(F.col("block_type") == kind) for n, kind in COUNTED.items()}, "total_notes": F.count_if(F.col("block_type").isin(*NOTES))}
    # The summary's notes: a pair counts once there, and twice in the recount.
    own = {**actual, "total_notes": logical_notes()}
    stated = [c.alias(f"stated_{n}") for n, c in own.items()] if summary is None else []
    found = neighbours.groupBy("document_id").agg(*[c.alias(n) for n, c in actual.items()], *stated, *counts, *listed)
    if documents is not None:
        found = documents.select("document_id").distinct().join(found, "document_id", "left")
    if summary is not None:
        found = found.join(summary.select("document_id", *[F.col(n).alias(f"stated_{n}") for n in actual]), "document_id", "left")
    lost = _strings()
    if candidates is not None:
        unknown = candidates.join(base.select("document_id", "block_id"), ["document_id", "block_id"], "left_anti").groupBy("document_id")
        found = found.join(unknown.agg(F.array_sort(F.collect_list("candidate_id")).alias("unknown")), "document_id", "left")
        lost = F.coalesce("unknown", lost)
    differs = [F.when(F.coalesce(F.col(n), F.lit(0)) != F.coalesce(F.col(f"stated_{n}"), F.lit(0)), F.lit(n)) for n in actual]
    found = found.withColumns({"differing": F.array_compact(F.array(*differs)), "lost": lost})

    def result(check: Check) -> Column:
        if check.document is not None:
            issues, ids = check.document()
        else:
            issues, ids = F.coalesce(F.col(f"n_{check.name}"), F.lit(0)), F.coalesce(F.col(f"ids_{check.name}"), _strings())
        fine = issues == 0
        status, message = F.when(fine, "passed").otherwise("failed"), F.when(fine, check.passed).otherwise(check.failed)
        return F.struct(F.lit(check.name).alias("name"), status.alias("status"), issues.cast("long").alias("issues"), message.alias("message"), ids.alias("offending"))

    return found.select("document_id", F.explode(F.array(*[result(c) for c in checks])).alias("x")).select("document_id", "x.*")


def report(checks: DataFrame) -> DataFrame:
    status = F.col("status")
    return checks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if(status == "passed").alias("passed_checks"), F.count_if(status == "warning").alias("warning_checks"),
        F.count_if(status == "failed").alias("failed_checks"), F.bool_and(status != "failed").alias("downstream_ready"),
    )


def batch(checks: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Counters over documents, and the failures of each check (name, failures) by name.

    issues: input_path, status of inputs that gave no document.
    """
    # Checks are folded once: each document gives its state and the names of its failed checks, which are counted together.
    failed = F.col("status") == "failed"
    folded = checks.groupBy("document_id").agg(F.bool_or(failed).alias("bad"), F.count_if(F.col("status") == "warning").alias("warnings"), F.collect_list(F.when(failed, F.col("name"))).alias("names"))
    blank = F.lit(None).cast("string")
    state = F.struct(blank.alias("name"), F.when(F.col("bad"), "failed").otherwise("passed").alias("state"), F.col("warnings"))
    failing = F.transform("names", lambda n: F.struct(n.alias("name"), blank.alias("state"), F.lit(0).cast("long").alias("warnings")))
    rows = folded.select(F.explode(F.concat(F.array(state), failing)).alias("x")).select("x.*")
    if issues is not None:
        rows = rows.unionByName(issues.select(blank.alias("name"), F.col("status").alias("state"), F.when(F.col("status") == "warning", 1).otherwise(0).cast("long").alias("warnings")))
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("failures"), F.count("state").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("passed", "failed")], F.sum("warnings").alias("warnings"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(
        total("total").alias("total_documents"), total("passed").alias("passed_documents"), total("failed").alias("failed_documents"), total("warnings").alias("warnings"),
        F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "failures")))).alias("failed_checks"),
    )


def failures_by_check(checks: DataFrame) -> DataFrame:
    return checks.filter("status = 'failed'").groupBy("name").agg(F.count(F.lit(1)).alias("failures"))


def resolve(spark: SparkSession, inputs: list[str]) -> list[tuple[str, bool, bool]]:
    """Full name, existence and whether it is a folder of each input, in any store that Spark reads."""
    out = []
    for name in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        there = files.exists(path)
        out.append((files.makeQualified(path).toString(), there, there and files.getFileStatus(path).isDirectory()))
    return out


def one_name(path: Column) -> Column:
    """file:/x and file:///x name one file."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def list_inputs(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """path, exists of the inputs: files as they are, folders as the files in them.

    Paths are full names, so one file is one path however it was named. Spark lists the folders; files are not read.
    """
    found = resolve(spark, inputs)
    rows = spark.createDataFrame([(full, there) for full, there, folder in found if not folder], "path string, exists boolean")
    if folders := [full for full, _, folder in found if folder]:
        rows = rows.unionByName(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path", F.lit(True).alias("exists")))
    return rows.withColumn("path", one_name(F.col("path"))).distinct()


def discover(paths: DataFrame, suffix: str = ".docx") -> tuple[DataFrame, DataFrame]:
    """Distinct inputs of the right kind, and issues (input_path, status, message) for the rest, from path, exists."""
    right = F.lower("path").endswith(suffix)
    good = paths.filter(F.col("exists") & right).select("path").distinct()
    status = F.when(~F.col("exists"), "failed").otherwise("warning")
    message = F.when(~F.col("exists"), "Input path does not exist.").otherwise("Skipped non-DOCX input path.")
    return good, paths.filter(~F.col("exists") | ~right).select(F.col("path").alias("input_path"), status.alias("status"), message.alias("message"))

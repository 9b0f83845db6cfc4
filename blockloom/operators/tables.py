"""Tables with merged cells, from one row per grid position (document_id, row, col, cell_key, text).

layout() makes these from the cells as they are written: how many columns each spans, and whether it goes on with the
cell above. laid_out() keeps a table's positions in one array (document_id, held), as grid() does with its texts; spans(),
grid() and grid_cells() take either form, and of the latter need no further sort of positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def cell_text(c: Column) -> Column:
    return t.null_if_empty(t.collapsed(c))


def layout(cells: DataFrame, look: list[str] | None = None) -> DataFrame:
    """Grid positions of cells written as document_id, row, place (in the row), span, merge and text; see laid_out()."""
    listed = F.array_sort(F.collect_list(F.struct("place", "span", "merge", "text", *look or [])))
    held = laid_out(cells.groupBy("document_id", "row").agg(listed.alias("cells")), look)
    found = held.select("document_id", F.explode("held").alias("h"))
    return found.select("document_id", "h.row", "h.col", _key(F.col("h")).alias("cell_key"), *[F.col(f"h.{c}") for c in ["text", *(look or [])]])


def laid_out(rows: DataFrame, look: list[str] | None = None) -> DataFrame:
    """The grid positions of each table, as an array, from its rows: document_id, row, and cells in the order of their place.

    A cell starts where the spans before it in its row end. At each of its columns a cell whose merge is `continue` is the
    one that lies above there, through as many rows as go on; without a position above, it is a cell of its own. Rows may be
    of different lengths. text and the columns of look are those of the cell that the position belongs to; where merged
    cells don't cover the same columns, positions follow their own column. first and start are the cell's row and column.
    """
    names = ["text", *(look or [])]
    width = lambda c: F.greatest(F.coalesce(c["span"], F.lit(1)), F.lit(1)).cast("long")
    none = F.lit(0).cast("long")

    def spread(row: Column, cells: Column, c: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(cells, F.lit(1), i), none, lambda s, x: s + width(x))
        spot = lambda s: F.transform(F.sequence(s, s + width(c) - 1), lambda col: F.struct(col.alias("col"), row.alias("row"), s.alias("start"), c["merge"].alias("merge"), *[c[x].alias(x) for x in names]))
        return F.flatten(F.transform(F.array(start), spot))

    def runs(spots: Column, begin: Column) -> Column:
        def run(b: Column, till: Column) -> Column:
            own = lambda x: [x["row"].alias("first"), x["start"].alias("start"), *[x[c].alias(c) for c in names]]
            return t.let(F.get(spots, b), lambda x: F.transform(F.slice(spots, b + 1, till - b), lambda y: F.struct(y["row"].alias("row"), y["col"].alias("col"), *own(x))))

        return F.flatten(F.transform(begin, lambda b, k: run(b, F.coalesce(F.get(begin, k + 1), F.size(spots)))))

    def held(spots: Column) -> Column:
        above = lambda x, y: (y["col"] == x["col"]) & (y["row"] == x["row"] - 1)
        goes_on = lambda i: F.coalesce((F.get(spots, i)["merge"] == "continue") & above(F.get(spots, i), F.get(spots, i - 1)), F.lit(False))
        return t.let(F.filter(_places(spots), lambda i: (i == 0) | ~goes_on(i)), lambda begin: runs(spots, begin))

    spots = F.flatten(F.transform("rows", lambda r: F.flatten(F.transform(r["cells"], lambda c, i: spread(r["row"], r["cells"], c, i)))))
    out = rows.groupBy("document_id").agg(F.collect_list(F.struct("row", "cells")).alias("rows"))
    return out.select("document_id", t.let(F.sort_array(spots), held).alias("held"))


def _key(h: Column) -> Column:
    return F.concat_ws(":", h["first"], h["start"])


def _places(array: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), F.size(array)), F.lit(1), F.size(array))


def _parted(held: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """parts: the positions of each table in an order, divided where one of the fields of by changes."""
    fields = [*order, *[f.name for f in held.schema["held"].dataType.elementType.fields if f.name not in order]]

    def parts(spots: Column) -> Column:
        same = lambda x, y: reduce(lambda a, b: a & b, [x[c] == y[c] for c in by])
        begins = F.filter(_places(spots), lambda i: (i == 0) | ~same(F.get(spots, i), F.get(spots, i - 1)))
        part = lambda begin, b, k: F.slice(spots, b + 1, F.coalesce(F.get(begin, k + 1), F.size(spots)) - b)
        return t.let(begins, lambda begin: F.transform(begin, lambda b, k: part(begin, b, k)))

    ordered = F.sort_array(F.transform("held", lambda h: F.struct(*[h[x].alias(x) for x in fields])))
    return held.select("document_id", t.let(ordered, parts).alias("parts"))


def _cells_of(held: DataFrame) -> DataFrame:
    """One array p of positions, by row and column, for each physical cell."""
    return _parted(held, ["first", "start", "row", "col"], ["first", "start"]).select("document_id", F.explode("parts").alias("p"))


def with_keys(cells: DataFrame) -> DataFrame:
    """cell_key: one for each run of equal texts that adjoin in a column."""
    down = Window.partitionBy("document_id", "col").orderBy("row")
    breaks = F.when(F.col("text").eqNullSafe(F.lag("text").over(down)) & (F.lag("row").over(down) == F.col("row") - 1), 0).otherwise(1)
    return cells.withColumn("breaks", breaks).withColumn("cell_key", F.concat_ws(":", F.col("col").cast("string"), F.sum("breaks").over(down).cast("string"))).drop("breaks")


def spans(cells: DataFrame, look: list[str] | None = None) -> DataFrame:
    """Physical cells: first position, spans, text, and the columns of look."""
    if "held" in cells.columns:
        p = _cells_of(cells).select("document_id", "p", F.get("p", F.lit(0)).alias("h"), F.transform("p", lambda x: x["col"]).alias("c"))
        tall, wide = F.element_at("p", -1)["row"] - F.col("h.row") + 1, F.array_max("c") - F.array_min("c") + 1
        return p.select("document_id", _key(F.col("h")).alias("cell_key"), "h.row", F.array_min("c").alias("col"), tall.alias("row_span"), wide.alias("col_span"), cell_text(F.col("h.text")).alias("text"),
                        *[F.col(f"h.{x}") for x in look or []])
    first = F.struct("row", "col")
    return cells.groupBy("document_id", "cell_key").agg(
        F.min("row").alias("row"), F.min("col").alias("col"), (F.max("row") - F.min("row") + 1).alias("row_span"), (F.max("col") - F.min("col") + 1).alias("col_span"),
        F.min_by(cell_text(F.col("text")), first).alias("text"), *[F.min_by(c, first).alias(c) for c in look or []],
    )


def grid(cells: DataFrame) -> DataFrame:
    """Rows, columns, header rows and the padded matrix of texts."""
    if "held" in cells.columns:
        rows = F.transform("parts", lambda p: F.struct(F.transform(p, lambda x: cell_text(x["text"])).alias("texts")))
        out = _parted(cells, ["row", "col"], ["row"]).select("document_id", rows.alias("r"), F.array_max(F.transform("parts", lambda p: F.size(p))).alias("cols"))
    else:
        rows = cells.groupBy("document_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", cell_text(F.col("text")).alias("text")))), lambda x: x["text"]).alias("texts"))
        out = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("row", "texts"))).alias("r"), F.max(F.size("texts")).alias("cols"))
    padded = t.let(F.col("cols"), lambda n: F.transform("r", lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(r["texts"], i))))
    return out.select("document_id", F.size("r").alias("rows_count"), F.col("cols").alias("cols_count"), F.when(F.size("r") > 0, 1).otherwise(0).alias("header_rows"), padded.alias("cells"))


def grid_cells(cells: DataFrame) -> DataFrame:
    """Every grid position with the spans of the physical cell that starts there, if any."""
    if "held" in cells.columns:
        low = _cells_of(cells).select("document_id", "p", F.get("p", F.lit(0))["row"].alias("top"), F.transform("p", lambda x: x["col"]).alias("c")).withColumn("left", F.array_min("c"))
        sizes = [(F.element_at("p", -1)["row"] - F.col("top") + 1).alias("row_span"), (F.array_max("c") - F.col("left") + 1).alias("col_span")]
        out = low.select("document_id", "top", "left", *sizes, F.explode("p").alias("h"))
        starts = (F.col("h.row") == F.col("top")) & (F.col("h.col") == F.col("left"))
        return out.select("document_id", "h.row", "h.col", cell_text(F.col("h.text")).alias("text"), *[F.when(starts, F.col(x)).alias(x) for x in ("row_span", "col_span")])
    own = Window.partitionBy("document_id", "cell_key")
    low, high = (lambda c: F.min(c).over(own)), (lambda c: F.max(c).over(own))
    starts = (F.col("row") == low("row")) & (F.col("col") == low("col"))
    spans_ = [F.when(starts, high(c) - low(c) + 1).alias(f"{c}_span") for c in ("row", "col")]
    return cells.select("document_id", "row", "col", cell_text(F.col("text")).alias("text"), *spans_)

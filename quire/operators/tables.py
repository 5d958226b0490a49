"""From raw grids to typed tables: choice of strategy, row types, labels, column groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.text import SPACE, blank, short_hash, strip

STRATEGIES = ("lines", "text", "explicit")
#: Vertical distance at which a cell starts a new row.
ROW_GAP = 5.0
HEADER, WINDOW, GROUP_HEADER, SEPARATOR, DATA = "header", "window", "group_header", "separator", "data"


def best_strategy(counts: DataFrame, by: list[str], strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Of rows (by..., strategy, cells) the strategy with strictly the most cells; ties go to the earlier one.

    A strategy that found nothing never wins.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy")), F.lit(0))
    ranked = counts.where((F.col("cells") > 0) & (place > 0)).withColumn("_rank", F.struct(F.col("cells"), -place))
    return ranked.groupBy(*by).agg(F.max_by("strategy", "_rank").alias("strategy"), F.max("cells").alias("cells"))


def normal_grid(grid: Column) -> Column:
    """Stripped cells with single spaces, short rows padded to the widest."""
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: F.regexp_replace(strip(F.coalesce(c, F.lit(""))), f"{SPACE}+", " ")))
    width = F.array_max(F.transform(grid, F.size))
    return F.transform(clean, lambda row: F.concat(row, F.array_repeat(F.lit(""), (width - F.size(row)).cast("int"))))


def cell_count(grid: Column) -> Column:
    """Cells as extracted; padding does not count."""
    return F.aggregate(F.transform(grid, F.size), F.lit(0), lambda a, n: a + n)


def cell_confidence(has_box: Column) -> Column:
    """Of a cell."""
    return F.when(has_box, 0.92).otherwise(0.75)


def table_confidence(strategy: Column) -> Column:
    """Of a table."""
    return F.when(strategy == "lines", 0.92).otherwise(0.80)


def table_hash(grid: Column) -> Column:
    """T4: of the non-empty cells; null for a table without any."""
    cells = F.filter(F.flatten(grid), lambda c: c != "")
    return F.when(F.size(cells) > 0, short_hash(F.array_join(cells, "|")))


def place_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """T5: boxes (by..., x0, y0, x1, y1) with the row and column they are in, from 0, corners rounded.

    In order of y (to a tenth) then x, a box more than ROW_GAP off the one before starts a row; rows are sorted by x.
    """
    order = W.partitionBy(*by).orderBy(F.bround("y0", 1), "x0", "y0")
    gap = F.abs(F.col("y0") - F.lag("y0").over(order)) > ROW_GAP
    rows = boxes.withColumn("_new", F.when(gap, 1).otherwise(0)).withColumn("row", F.sum("_new").over(order).cast("int"))
    column = F.row_number().over(W.partitionBy(*by, "row").orderBy("x0", "y0")) - 1
    return rows.select(*by, "row", column.alias("col"), *[F.bround(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])


def clip_to_grid(placed: DataFrame, n_rows: Column, n_cols: Column) -> DataFrame:
    """T5: places outside the grid are dropped."""
    return placed.where((F.col("row") < n_rows) & (F.col("col") < n_cols))


def footnote_run(text: Column, space: str = SPACE) -> Column:
    """The single letters between commas at a cell's end, as many as there are and as they stand; empty if none.

    The end is read backwards first and nothing is tried twice, so that a run of any length takes time linear in the text and no stack.
    """
    run = rf"[a-z](?:{space}*,{space}*[a-z])*+"
    end = F.reverse(F.regexp_extract(F.reverse(text), rf"^{space}*+({run}{space}?)", 1))
    return F.regexp_extract(end, rf"{space}({run})$", 1)


def footnote_refs(text: Column) -> Column:
    """The marks at a cell's end: one letter or sign, or single letters between commas (at most five characters)."""
    many = footnote_run(text)
    one = F.regexp_extract(text, rf"{SPACE}([a-z*\x{{2020}}\x{{2021}}\x{{a7}}\x{{b6}}#]){SPACE}*$", 1)
    listed = F.transform(F.split(many, ","), strip)
    return F.when((many != "") & (F.length(many) <= 5), listed).when(F.coalesce(one, F.lit("")) != "", F.array(one)).otherwise(F.array().cast("array<string>"))


def row_type(row: Column, index: Column) -> Column:
    """Of a grid row. The last rule that applies counts, so the strongest comes first here."""
    filled = F.size(F.filter(row, lambda c: ~blank(c)))
    alone = ~blank(F.get(row, F.lit(0))) & (filled == 1)
    marks = F.exists(row, lambda c: ~blank(c) & (c.rlike(r"[\x{b1}\x{2264}\x{2265}<>]\s*[0-9]") | (F.upper(strip(c)) == "NA")))
    return (
        F.when(filled == 0, SEPARATOR)
        .when((F.size(row) > 3) & alone & (index > 0), GROUP_HEADER)
        .when(index == 0, HEADER)
        .when((index == 1) & F.coalesce(marks, F.lit(False)) & (filled > F.size(row) * F.lit(0.3)), WINDOW)
        .otherwise(DATA)
    )


def typed_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., row_index, cells) with row_type and, on data rows, the label of the group header above."""
    typed = rows.withColumn("row_type", row_type(F.col("cells"), F.col("row_index")))
    above = W.partitionBy(*by).orderBy("row_index").rowsBetween(W.unboundedPreceding, 0)
    label = F.last(F.when(F.col("row_type") == GROUP_HEADER, strip(F.get("cells", F.lit(0)))), ignorenulls=True).over(above)
    return typed.withColumn("_label", label).withColumn("group_label", F.when(F.col("row_type") == DATA, F.col("_label"))).drop("_label")


def headers(grid: Column) -> Column:
    """The first row unless it is blank."""
    return F.when(row_type(F.get(grid, F.lit(0)), F.lit(0)) == HEADER, F.get(grid, F.lit(0))).otherwise(F.array().cast("array<string>"))


def column_groups(cells: DataFrame, by: list[str]) -> DataFrame:
    """Of header cells (by..., col, text): each run of two and more equal non-blank neighbours, with its columns."""
    order = W.partitionBy(*by).orderBy("col")
    text = strip(F.coalesce("text", F.lit("")))
    islands = cells.withColumn("label", text).withColumn("_new", F.when(F.col("label").eqNullSafe(F.lag("label").over(order)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return (
        islands.where("label <> ''").groupBy(*by, "_island", "label")
        .agg(F.array_sort(F.collect_list("col")).alias("column_indices")).where(F.size("column_indices") > 1).drop("_island")
    )

"""Two extractions of a table joined cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.similarity import sequence_ratio
from quire.text import strip

# What counts as ticked, and as empty.
CHECKS = ("x", "✓", "✔", "✕", "✗", "yes", "√")
EMPTIES = ("", "-", "—", "n/a", "na", "none")
ALIGN_AT_LEAST, SAME_ABOVE, LONGER = 0.5, 0.85, 1.5
VISION_ONLY, TEXT_ONLY = 0.75, 0.90


def plain(value: Column) -> Column:
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def same_without_ratio(a: Column, b: Column) -> Column:
    """R3 but for its last rule: equal, both ticked, or both empty."""
    x, y = plain(a), plain(b)
    return (x == y) | (x.isin(*CHECKS) & y.isin(*CHECKS)) | (x.isin(*EMPTIES) & y.isin(*EMPTIES))


def is_numeric(text: Column) -> Column:
    """Holds a digit, or is a float's nan or infinity once signs of money and separators are gone."""
    bare = F.regexp_replace(F.lower(text), r"[%$€£,\s]", "")
    return text.rlike("[0-9]") | bare.rlike("^[+-]?(nan|inf|infinity)$")


def resolution(text: Column, vision: Column) -> Column:
    """Whose value a conflict takes, and why."""
    both = lambda who, why: F.struct(F.lit(who).alias("resolution"), F.lit(why).alias("reason"))
    return (
        F.when(is_numeric(text) | is_numeric(vision), both("text", "numeric — text extraction more reliable for digits"))
        .when((text == "") & (vision != ""), both("vision", "text extraction missed this cell"))
        .when((text != "") & (vision == ""), both("text", "vision extraction missed this cell"))
        .when(F.length(vision) > F.length(text) * F.lit(LONGER), both("vision", "vision has more detail"))
        .otherwise(both("text", "text value preferred (default)"))
    )


def align_columns(text_headers: DataFrame, vision_headers: DataFrame, by: list[str]) -> DataFrame:
    """R2: (by..., t_col, v_col): for each text header (by..., t_col, header) the most similar vision header (by..., v_col,
    header), the first of equal ones, if similar enough. Tables are joined by their key; only headers of one table meet."""
    pairs = text_headers.withColumnRenamed("header", "_t").join(vision_headers.withColumnRenamed("header", "_v"), by)
    scored = pairs.withColumn("_score", sequence_ratio(plain(F.col("_t")), plain(F.col("_v")))).where(F.col("_score") >= ALIGN_AT_LEAST)
    return scored.groupBy(*by, "t_col").agg(F.max_by("v_col", F.struct(F.col("_score"), -F.col("v_col"))).alias("v_col"))


def compare_cells(text_cells: DataFrame, vision_cells: DataFrame, mapping: DataFrame, by: list[str], fuzzy: bool = True) -> DataFrame:
    """(by..., row, col, text_value, vision_value, same, resolution, reason, merged) of every cell both have.

    Cells are (by..., row, col, value). The ratio runs on the cells that the built-in rules leave open, no others.
    """
    left = text_cells.select(*by, "row", F.col("col").alias("t_col"), F.col("value").alias("original"), strip(F.coalesce("value", F.lit(""))).alias("text_value"))
    right = vision_cells.select(*by, "row", F.col("col").alias("v_col"), strip(F.coalesce("value", F.lit(""))).alias("vision_value"))
    met = left.join(mapping, [*by, "t_col"]).join(right, [*by, "row", "v_col"])
    same = same_without_ratio(F.col("text_value"), F.col("vision_value"))
    if fuzzy:
        long = (F.length(plain(F.col("text_value"))) > 3) & (F.length(plain(F.col("vision_value"))) > 3)
        settled = met.withColumn("same", same).withColumn("_open", ~F.col("same") & long)
        near = settled.where("_open").withColumn("same", sequence_ratio(plain(F.col("text_value")), plain(F.col("vision_value"))) > SAME_ABOVE)
        met = settled.where("not _open").unionByName(near).drop("_open")
    else:
        met = met.withColumn("same", same)
    told = met.withColumn("_how", F.when(~F.col("same"), resolution(F.col("text_value"), F.col("vision_value"))))
    return told.select(
        *by, "row", F.col("t_col").alias("col"), "text_value", "vision_value", "same", "_how.resolution", "_how.reason",
        F.when(F.col("_how.resolution") == "vision", F.col("vision_value")).otherwise(F.col("original")).alias("merged"),
    )


def merged_cells(text_cells: DataFrame, vision_cells: DataFrame, mapping: DataFrame, by: list[str], fuzzy: bool = True) -> DataFrame:
    """(by..., row, col, value, source): the table in the text's columns.

    Rows past the text's last come from vision, remapped, "" where a column has no match. A table that only one side has
    is that side's. Unlike a table without cells, one with blank cells is there.
    """
    sides = text_cells.groupBy(*by).agg(F.max("row").alias("t_rows"), F.max("col").alias("t_cols")).join(
        vision_cells.groupBy(*by).agg(F.max("row").alias("v_rows")), by, "full"
    )
    compared = compare_cells(text_cells, vision_cells, mapping, by, fuzzy).select(*by, "row", "col", F.col("merged"))
    both = sides.where("t_rows is not null and v_rows is not null").select(*by)
    kept = text_cells.join(compared, [*by, "row", "col"], "left").select(*by, "row", "col", F.coalesce("merged", "value").alias("value"))
    marked = kept.join(both.withColumn("source", F.lit("merged")), by, "left").withColumn("source", F.coalesce("source", F.lit("text")))
    extra_rows = sides.where("v_rows > t_rows").select(*by, "t_cols", F.explode(F.expr("sequence(t_rows + 1, v_rows)")).alias("row"))
    grid = extra_rows.select(*by, "row", F.explode(F.expr("sequence(0, t_cols)")).alias("t_col"))
    remapped = vision_cells.withColumnRenamed("col", "v_col").join(mapping, [*by, "v_col"]).select(*by, "row", "t_col", "value")
    extra = grid.join(remapped, [*by, "row", "t_col"], "left").select(*by, "row", F.col("t_col").alias("col"), F.coalesce("value", F.lit("")).alias("value"), F.lit("merged").alias("source"))
    alone = vision_cells.join(sides.where("t_rows is null").select(*by), by, "left_semi").select(*by, "row", "col", "value", F.lit("vision").alias("source"))
    return marked.unionByName(extra).unionByName(alone)


def confidence(compared: DataFrame, by: list[str]) -> DataFrame:
    """Cells compared, conflicts, and one less their share."""
    counts = compared.groupBy(*by).agg(F.count("*").alias("total_cells"), F.count_if(~F.col("same")).alias("conflicts"))
    return counts.withColumn("confidence", 1 - F.col("conflicts") / F.greatest("total_cells", F.lit(1)))


def fallback(n_text_rows: Column, n_vision_rows: Column) -> Column:
    """Source and confidence where one side or both are empty; null where they have to be compared."""
    say = lambda source, value: F.struct(F.lit(source).alias("source"), F.lit(value).alias("confidence"))
    none = lambda n: F.coalesce(n, F.lit(0)) == 0
    return F.when(none(n_text_rows) & none(n_vision_rows), say("text", 1.0)).when(none(n_text_rows), say("vision", VISION_ONLY)).when(none(n_vision_rows), say("text", TEXT_ONLY))


def surplus(rows: DataFrame, by: list[str], limit: DataFrame) -> DataFrame:
    """Rows of one side whose number passes the other side's (by..., n_rows)."""
    return rows.join(limit, by).where(F.col("row") >= F.col("n_rows")).drop("n_rows")


def in_order(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., row, cells): cells of a row as an array, in column order."""
    listed = F.array_sort(F.collect_list(F.struct("col", "value")))
    return cells.groupBy(*by, "row").agg(F.transform(listed, lambda x: x["value"]).alias("cells")).withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("row"))).drop("_n")

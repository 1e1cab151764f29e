"""Tables of parsed pages: from rows of text, from words in a grid of rules, and as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t\x0b\x0c\r]{2,}"


def text_rows(text: Column) -> Column:
    """array<array<string>>: lines of two parts or more, parted by bars, else tabs, else runs of two spaces."""

    def parts(line: Column) -> Column:
        bare = F.trim(line)
        bars = F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|", -1)
        by = F.when(F.contains(line, F.lit("|")), bars).when(F.contains(line, F.lit("\t")), F.split(line, "\t", -1)).when(line.rlike(SPACES), F.split(bare, SPACES, -1)).otherwise(F.array().cast("array<string>"))
        return F.transform(by, lambda p: F.trim(p))

    return F.filter(F.transform(F.split(text, "\n"), parts), lambda p: F.size(p) >= 2)


def markdown(rows: Column) -> Column:
    """Rows as a markdown table, the first its header; short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def tables_of_text(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, table_id, n_rows, n_cols, markdown, confidence of pages (text) with two rows or more."""
    df = pages.select(*keep, text_rows(F.col("text")).alias("rows")).where(F.size("rows") >= 2)
    df = df.select(*keep, F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r))).alias("n_cols"), markdown(F.col("rows")).alias("markdown"), F.lit(0.55).alias("confidence"))
    return df.withColumn("table_id", F.left(F.sha2("markdown", 256), F.lit(8)))


def distinct_rules(values: Column, tolerance: float = 2.0) -> Column:
    """Sorted places of rules without those within tolerance of the last one kept: a fold, as each depends on it. For
    the rules of one page."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), start, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) > tolerance), F.array_append(acc, v)).otherwise(acc))


def tables_of_grid(words: DataFrame, grids: DataFrame, key: list[str]) -> DataFrame:
    """key, row, cells: words (key, x0, y0, x1, y1, text) in the grid of their page (key, ys, xs: sorted places of rules).
    A word belongs to each cell that its centre lies in, give or take 1; a cell's words stand by x0 and text. Rows without
    a word go, and so do tables of fewer than two rows or columns. A page's words meet its grid by key alone."""
    inside = lambda at, rules: F.filter(F.sequence(F.lit(0), F.size(rules) - 2), lambda i: (at >= F.get(rules, i) - 1) & (at <= F.get(rules, i + 1) + 1))
    g = grids.where((F.size("ys") >= 3) & (F.size("xs") >= 3))
    df = words.join(g, key)
    df = df.select(*key, "xs", "x0", "text", F.explode(inside((F.col("y0") + F.col("y1")) / 2, F.col("ys"))).alias("row"), ((F.col("x0") + F.col("x1")) / 2).alias("_x"))
    df = df.select(*key, "row", F.size("xs").alias("_n"), "x0", "text", F.explode(inside(F.col("_x"), F.col("xs"))).alias("col"))
    cells = df.groupBy(*key, "_n", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("cell"))
    rows = cells.groupBy(*key, "_n", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.col("_n") - 2), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    rows = rows.select(*key, "row", full.alias("cells"))
    return rows.join(rows.groupBy(*key).count().where("count >= 2").select(*key), key, "left_semi")


def cell_box(box: Column, row: Column, col: Column, n_rows: Column, n_cols: Column) -> Column:
    """The box [x0, y0, x1, y1] of a cell, cut evenly from its table's."""
    at = lambda i, j, k, n: box[i] + (box[j] - box[i]) * k / n
    return F.array(at(0, 2, col, n_cols), at(1, 3, row, n_rows), at(0, 2, col + 1, n_cols), at(1, 3, row + 1, n_rows))

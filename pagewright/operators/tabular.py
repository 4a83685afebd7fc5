"""Rows of cells as Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def cell(value: Column) -> Column:
    """A null cell is empty; pipes are escaped and line ends become blanks."""
    v = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return T.strip(v)


def blank_row(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.isNull() | T.is_blank(c))


def markdown_tables(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content) from (key, row_idx, cells): the first row is the head; short rows are filled up to the widest one."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"), F.max(F.size("cells")).alias("width"))

    def line(r: Column) -> Column:
        padded = F.concat(F.transform(r["cells"], cell), F.array_repeat(F.lit(""), F.col("width") - F.size(r["cells"])))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    lines = F.transform(F.col("rows"), line)
    return listed.select(key, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n").alias("content"))

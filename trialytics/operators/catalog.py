"""Catalogue records from Markdown reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialytics.functions.coerce import nonempty
from trialytics.functions.text import LINE_END, is_separator, markdown_cells


def fold_first(df: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """For each key the first non-empty value of every field, by order."""
    return df.groupBy(key).agg(*(F.min_by(nonempty(f), F.when(nonempty(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def fold_notes(df: DataFrame, key: str, order: str, note: str) -> DataFrame:
    """Notes joined with '; ' in order, each unless it is part of what is there already. A key's notes are few."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(nonempty(note).isNotNull(), F.struct(order, note)))), lambda s: s[note])
    joined = F.aggregate(ordered, F.lit(""), lambda s, v: F.when(s == "", v).when(s.contains(v), s).otherwise(F.concat(s, F.lit("; "), v)))
    return df.groupBy(key).agg(joined.alias(note))


def table_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, row_no, header, cells of all Markdown tables.

    Neighbouring lines with equally many cells form a run. The first separator of a run that
    isn't its first line makes a table of it: the line before is the header, all lines after
    are rows. Lines are numbered and runs found within a document.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), LINE_END)).alias("line_no", "line")).withColumn("cells", markdown_cells("line")).where("cells is not null").withColumn("width", F.size("cells"))
    by_doc = Window.partitionBy(key).orderBy("line_no")
    joins = (F.lag("line_no").over(by_doc) == F.col("line_no") - 1) & (F.lag("width").over(by_doc) == F.col("width"))
    runs = lines.withColumn("starts", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("starts").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(key, "run")
    opened = runs.withColumn("rule", F.min(F.when(is_separator("cells") & (F.col("starts") == 0), F.col("line_no"))).over(run))
    headed = opened.withColumn("header", F.max(F.when(F.col("line_no") == F.col("rule") - 1, F.col("cells"))).over(run)).where("line_no > rule")
    numbered = headed.withColumns({"table_no": F.dense_rank().over(Window.partitionBy(key).orderBy("run")), "row_no": F.row_number().over(run.orderBy("line_no"))})
    return numbered.select(key, "table_no", "row_no", "header", "cells")


def normalize_granularity(granularity: Column, repository: Column, name: Column) -> Column:
    """Granularity names by repository; others stay as they are."""
    text = F.lower(granularity)
    web = F.when(text.contains("module"), "module_files").when(text.contains("class"), "class_span")
    ini = F.when(text.contains("class") | name.isin("INIReader", "INIWriter"), "class_span")
    return F.coalesce(F.when(repository == "Echo-Web-Server", web).when(repository == "ini-cpp", ini), granularity)


def missing_fields(fields: Sequence[tuple[str, Column]]) -> Column:
    """Names of the fields whose condition of absence holds, in order."""
    return F.array_compact(F.array(*(F.when(absent, name) for name, absent in fields)))


def split_excluded(df: DataFrame, status: str, mark: str = "除外") -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) by whether the status contains the mark; null and empty statuses are kept."""
    out = F.coalesce(F.col(status), F.lit("")).contains(mark)
    return df.where(~out), df.where(out)

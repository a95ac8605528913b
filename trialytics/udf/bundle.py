"""Design bundles: named files one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialytics.functions.text import include_lines
from trialytics.udf.cpp import without_bodies_udf

# Header suffixes.
HEADERS = (".h", ".hh", ".hpp", ".hxx")


def bundle(files: DataFrame, key: str, order: str, name: Column, text: Column) -> DataFrame:
    """key, bundle: each file under a heading line, in order. A key's files are few."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("===== FILE: "), name, F.lit(" =====\n"), text).alias("t"))))
    return files.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("bundle"))


def parts_of(files: DataFrame, key: str, order: str, name: str, text: str) -> DataFrame:
    """key, design, scaffold, dependency of source files: all files, the headers without bodies, and the different includes in order."""
    said = lambda t: F.concat(F.lit("===== FILE: "), F.col(name), F.lit(" =====\n"), F.regexp_replace(t, r"\s+\z", ""), F.lit("\n"))
    header = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))).isin(*HEADERS)
    held = files.withColumn("_bare", F.when(header, without_bodies_udf(F.col(text))))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said(F.col(text)).alias("d"), F.when(header, said(F.col("_bare"))).alias("s"), include_lines(text).alias("i"))))
    grouped = held.groupBy(key).agg(listed.alias("l"))
    joined = lambda f: F.array_join(F.transform("l", lambda p: p[f]), "\n")
    includes = F.array_distinct(F.flatten(F.transform("l", lambda p: p["i"])))
    return grouped.select(key, joined("d").alias("design"), joined("s").alias("scaffold"), F.concat(F.array_join(includes, "\n"), F.lit("\n")).alias("dependency"))

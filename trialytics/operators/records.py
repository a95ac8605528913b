"""Wide records from artefact tables: stage assembly, flattening, presentation order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialytics.functions.coerce import stage_status
from trialytics.functions.fmt import ratio
from trialytics.schemas import STAGE_ATTRIBUTES, STAGES


def flatten_stages(stages: DataFrame, key: str = "target_id", order: Sequence[str] = STAGES, attributes: Sequence[str] = STAGE_ATTRIBUTES) -> DataFrame:
    """One row a key with <stage>_<attribute> columns: conditional aggregates, one shuffle."""
    return stages.groupBy(key).agg(*(F.max(F.when(F.col("stage") == s, F.col(a))).alias(f"{s}_{a}") for s in order for a in attributes))


def stages_of(evaluations: DataFrame, dimension: DataFrame, key: str = "target_id") -> DataFrame:
    """Long stages of evaluation documents (a map `stages`): six rows a document, tests from the nested counts."""
    at = F.try_element_at(F.col("stages"), F.col("stage"))
    rows = evaluations.select(key, "stages").crossJoin(F.broadcast(dimension)).withColumn("s", at)  # the dimension is six rows
    return rows.select(
        key, "stage_order", "stage", stage_status(F.col("s.skipped"), F.col("s.passed"), F.col("s.status"), F.col("s").isNotNull()).alias("status"),
        "s.exit_code", "s.timed_out", "s.elapsed_seconds", F.col("s.counts.ran").alias("tests_ran"), F.col("s.counts.passed").alias("tests_passed"), F.col("s.counts.failed").alias("tests_failed"), "s.stdout_log", "s.stderr_log",
    )


def size_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("generated_original_loc_ratio", ratio("generated_loc", "original_loc"))


def failures_of(df: DataFrame, columns: Sequence[str], passed: Column | None = None) -> DataFrame:
    """The records that failed; an unknown result isn't a failure."""
    return df.where((F.col("overall_pass") if passed is None else passed) == F.lit(False)).select(*columns)


def union_records(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def presented(df: DataFrame, repository: str = "repository", target: str = "target_id") -> DataFrame:
    """In presentation order, numbered from 1. For reports: all rows pass one task."""
    order = [F.lower(repository), F.lower(target)]
    return df.withColumn("no", F.row_number().over(Window.orderBy(*order))).orderBy("no")

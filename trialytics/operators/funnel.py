"""Stages in order: funnel, skip propagation, first failures, pass rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_funnel(stages: DataFrame, dimension: DataFrame, n: str | None = None) -> DataFrame:
    """For each stage of the dimension, in order, rows by status; reached = passed + failed; stages without rows count 0. n: a column that says for how many rows a row stands."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s)) if n is None else F.sum(F.when(F.col("status").isin(*s), F.col(n)))
    counts = stages.groupBy("stage").agg(is_("passed").alias("passed"), is_("failed").alias("failed"), is_("skipped").alias("skipped"), is_("not_recorded", "unknown").alias("not_recorded_or_unknown"))
    named = ("passed", "failed", "skipped", "not_recorded_or_unknown")
    joined = dimension.join(counts, "stage", "left").select("stage_order", "stage", *(F.coalesce(n, F.lit(0)).alias(n) for n in named))
    return joined.withColumn("reached", F.col("passed") + F.col("failed")).orderBy("stage_order")


def propagate_skips(df: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """skipped: whether an earlier stage of the key failed."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("skipped", F.coalesce(F.max(failed.cast("int")).over(before), F.lit(0)) == 1)


def skip_after_first(df: DataFrame, keys: Sequence[str], order: str, failed: Column) -> DataFrame:
    """skipped: whether an earlier row of the keys failed, as propagate_skips says it, for keys with very many rows: the first failures are aggregated and joined, in a join that Spark can split. Null keys are keys."""
    first = df.where(failed).groupBy(*keys).agg(F.min(order).alias("_first"))
    same = reduce(Column.__and__, (F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys))
    return df.alias("d").join(first.alias("f"), same, "left").select("d.*", F.coalesce(F.col(f"d.{order}") > F.col("f._first"), F.lit(False)).alias("skipped"))


def first_failure(df: DataFrame, key: str, order: str, stage: str, failed: Column) -> DataFrame:
    """key, first_stage: the first failed stage of each key that has one. Partial aggregation, no sort."""
    return df.where(failed).groupBy(key).agg(F.min_by(stage, order).alias("first_stage"))


def stage_passes(exit_code: Column, ran: Column, passed: Column, failed: Column, expected: Column, timed_out: Column) -> Column:
    """A clean exit in time with exactly the expected tests, all passed; nulls don't pass."""
    return exit_code.eqNullSafe(F.lit(0)) & ran.eqNullSafe(expected) & passed.eqNullSafe(expected) & expected.isNotNull() & failed.eqNullSafe(F.lit(0)) & ~F.coalesce(timed_out, F.lit(False))


def overall_passes(stages: DataFrame, key: str, passed: Column, error: Column, restored: Column, clean: Column, expected: int = 4) -> DataFrame:
    """key, overall_pass: no error, all expected stages passed, restored and clean."""
    good = F.coalesce(F.every(F.coalesce(passed, F.lit(False))), F.lit(False)) & (F.count("*") >= expected)
    rest = F.every(error.isNull()) & F.every(F.coalesce(restored, F.lit(False))) & F.every(F.coalesce(clean, F.lit(False)))
    return stages.groupBy(key).agg((good & rest).alias("overall_pass"))

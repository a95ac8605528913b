"""Validation rules: each a condition over records; their violations in one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialytics.schemas import STAGES


# Scopes that are larger than a class or a function.
FALLBACK_SCOPES = ("whole_source_files_fallback", "whole_source_files_repository_fallback", "legacy_backup_tree_fallback")


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, rule_no, message for every rule that a row breaks; one scan for all row-wise rules."""
    broken = F.array_compact(F.array(*(F.when(condition, F.struct(F.lit(i).alias("rule_no"), F.lit(message).alias("message"))) for i, (message, condition) in enumerate(rules, 1))))
    return df.select(key, F.explode(broken).alias("v")).select(key, "v.rule_no", "v.message")


def record_rules() -> list[tuple[str, Column]]:
    """Consistency of a wide record."""
    c = F.col
    failed = lambda s: c(f"{s}_status") == "failed"
    return [
        ("unknown overall result", c("overall_pass").isNull()),
        ("size measured at another scope", c("granularity").isin("class_span", "function") & c("original_measurement_scope").isin(*FALLBACK_SCOPES)),
        ("passed with failed stages", c("overall_pass") & reduce(Column.__or__, (F.coalesce(failed(s), F.lit(False)) for s in STAGES))),
        ("retry or repair recorded", F.coalesce(c("retry_performed"), F.lit(False)) | F.coalesce(c("automatic_repair_performed"), F.lit(False))),
        ("stopped without generated size", (c("code_done_reason") == "stop") & c("generated_loc").isNull() & ~F.coalesce(c("legacy_format"), F.lit(False))),
        ("design stopped but not passed", (c("design_done_reason") == "stop") & ~c("design_generation_status").eqNullSafe("passed")),
        ("code reason against its stage", (c("code_done_reason") == "length") & ~c("code_regeneration_status").eqNullSafe("failed") | (c("code_done_reason") == "stop") & ~c("code_regeneration_status").eqNullSafe("passed")),
    ]


def unexpected_summary(df: DataFrame, passed: Column, expected: tuple[int, int, int]) -> DataFrame:
    """One row if total, passed or failed differ from what a study expects."""
    total, ok, bad = expected
    return df.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed")).where(f"total <> {total} or passed <> {ok} or failed <> {bad}")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(0).alias("rule_no"), F.lit("duplicate").alias("message"))

"""Record shapes (as DDL) and fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stages in order, and failure codes.
STAGES = ("design_generation", "code_regeneration", "configure", "build", "direct_test", "full_test")
STATUSES = ("passed", "failed", "skipped", "not_recorded", "unknown")
METRICS = ("original_loc", "original_chars", "generated_loc", "expected_direct_tests", "expected_full_tests", "code_eval_count")


STAGE = "target_id string, stage_order int, stage string, status string, exit_code int, timed_out boolean, elapsed_seconds double, tests_ran int, tests_passed int, tests_failed int, stdout_log string, stderr_log string"
STAGE_ATTRIBUTES = ("status", "exit_code", "timed_out", "elapsed_seconds", "tests_ran", "tests_passed", "tests_failed")
COUNTS = "struct<ran:int,passed:int,failed:int>"
EVALUATION = (
    "schema_version string, target_id string, run_id string, completed_at_utc string, overall_pass boolean, error string, "
    f"stages map<string,struct<stage:string,exit_code:int,passed:boolean,skipped:boolean,timed_out:boolean,elapsed_seconds:double,stdout_log:string,stderr_log:string,status:string,counts:{COUNTS}>>, "
    "restoration struct<restored:boolean,original_hashes:map<string,string>,restored_hashes:map<string,string>,repository_clean:boolean>"
)
FAILURE = "schema_version string, target_id string, run_id string, failed_stage string, stage string, failure_stage string, error_type string, error string, recorded_at_utc string"
GENERATION = "started_at_utc string, elapsed_seconds double, done boolean, done_reason string, prompt_eval_count bigint, eval_count bigint, retry boolean, automatic_repair boolean"
MODULE_FILES = "files array<struct<path:string,content:string>>"


def stage_dimension(spark: SparkSession, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """stage_order (from 1), stage: one row a stage."""
    return spark.createDataFrame(list(enumerate(stages, 1)), "stage_order int, stage string")

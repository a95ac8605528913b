"""Wide records of a study, built from its artefacts: one row a target.

Every lookup is a join or an aggregate over one table of files (path, value, bytes): what a
target's folder holds comes together in one aggregation by target, whatever the number of
targets; nothing is read a second time and nothing is looped over on the driver.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialytics.functions import coerce, text
from trialytics.functions.fmt import ratio
from trialytics.operators import classify, lookup
from trialytics.operators.records import union_records
from trialytics.schemas import STAGE_ATTRIBUTES, STAGES
from trialytics.session import cut, prepare
from trialytics.sources import files

# Where a study keeps its files, relative to its root or to a target's folder, in order of preference.
CONFIGS = "configs/roundtrip/targets"
EXPERIMENTS = "experiments"
PILOTS = "pilot-failures"
TARGETS_CSV, RUNS_CSV = "manifests/targets.csv", "manifests/runs.csv"
BATCH = ("reports/batch/batch_execution.json", "reports/batch/batch_plan.json")
EVALUATIONS = ("evaluation/evaluation_manifest.json", "evaluation_manifest.json", "report/evaluation_manifest.json")
FAILURES = ("pipeline_failure.json", "evaluation/pipeline_failure.json", "report/pipeline_failure.json")
METADATA = ("raw_output/{}_metadata.json", "{}_metadata.json")
NORMALIZATION = ("raw_output/code_regeneration_normalization.json", "code_regeneration_normalization.json")
RESPONSE = "raw_output/code_regeneration_response.json"
SPAN_BACKUP, SPAN_INPUT, TREE_BACKUP = "backup/original_target.cpp", "input/design_input.txt", "backup/files/"
TREE_GENERATED, GENERATED = "generated/files/", "generated/"
LEGACY_ORIGINAL, LEGACY_GENERATED = "backup/original_write_body.cpp", "generated/regenerated_write_body.cpp"

# Columns of a record before those of its stages.
RECORD = (
    "target_id", "run_id", "repository", "target_name", "experiment_directory", "config_path", "legacy_format", "result_source", "granularity", "source_files", "test_files", "expected_direct_tests", "expected_full_tests", "num_ctx", "num_predict",
    "design_done_reason", "design_prompt_eval_count", "design_eval_count", "code_done_reason", "code_prompt_eval_count", "code_eval_count", "normalization_applied", "normalization_type", "strict_format_pass", "retry_performed", "automatic_repair_performed",
    "overall_pass", "result", "failure_stage", "failure_category", "failure_category_ja", "failure_detail", "original_loc", "original_chars", "original_measurement_scope", "generated_loc",
    "generated_chars", "generated_original_loc_ratio", "restored", "repository_clean", "total_recorded_elapsed_seconds", "data_quality_notes",
)
STAGE_KINDS = {"exit_code": "bigint", "timed_out": "boolean", "elapsed_seconds": "double", "tests_ran": "bigint", "tests_passed": "bigint", "tests_failed": "bigint"}
COLUMNS = (*RECORD, *(f"{s}_{a}" for s in STAGES for a in STAGE_ATTRIBUTES))

# Notes on a record.
NO_EVALUATION = "No evaluation_manifest.json was found; fallback status sources were used."
NO_SPAN = "Target-granularity backup was unavailable; original size was measured from complete restored repository source file(s)."
NO_RESULT = "Overall result could not be determined."
NO_STANDARD = "Legacy result used the fixed main-study definition because no standard manifest was available."
NO_BODY = "The legacy function-body backup was unavailable; original size used the complete legacy backup tree."
NO_GENERATED = "The legacy regenerated function body was unavailable; generated size used the complete legacy generated tree."


@dataclass(frozen=True)
class Legacy:
    """A target from before there were configurations: what its folder doesn't tell."""

    directory: str
    target_id: str
    run_id: str
    repository: str
    target_name: str
    granularity: str
    expected_direct_tests: int
    expected_full_tests: int
    overall_pass: bool


def artefacts(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), value (text, newlines unified, undecodable bytes replaced), bytes, sha256 of all files below root; readable: whether the bytes are UTF-8, which documents and manifests must be."""
    root = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.expr("substring(path, instr(path, root) + length(root) + 1)")
    value = text.unify_newlines(F.make_valid_utf8(F.col("content").cast("string")))
    return read.withColumn("root", F.lit(root)).select(below.alias("path"), value.alias("value"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("readable"))


def read_text(value: str = "value") -> Column:
    """The text of a file that is read as a document: null where its bytes aren't UTF-8."""
    return F.when(F.col("readable"), F.col(value))


def _get(doc: str, *paths: str, kind: str = "string") -> Column:
    return coerce.variant_path(doc, *paths, kind=kind)


def _of_row(row: str, *keys: str) -> Column:
    """The value of the first column that a manifest's row has."""
    return F.coalesce(*(F.when(F.map_contains_key(row, F.lit(k)), F.try_element_at(F.col(row), F.lit(k))) for k in keys))


def _object(value: str | Column) -> Column:
    """A text as a JSON object, else null."""
    x = F.col(value) if isinstance(value, str) else value
    doc = F.try_parse_json(F.regexp_replace(x, "^" + files.BOM, ""))
    return F.when(F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), doc)


def _is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def manifest_rows(docs: DataFrame, path: str) -> DataFrame:
    """no, row (map of strings) of a CSV manifest; no rows where there is none."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for value in frame["value"]:
                rows = [{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(value.removeprefix(files.BOM)))]
                yield pd.DataFrame({"no": range(len(rows)), "row": rows})

    return docs.where((F.col("path") == path) & F.col("readable")).select("value").mapInPandas(parse, "no long, row map<string,string>")


def batch_entries(docs: DataFrame) -> DataFrame:
    """id, entry (JSON): for every id the first object that bears it, the execution report before the plan, outside in."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, value in zip(frame["path"], frame["value"], strict=True):
                try:
                    waiting = [json.loads(value.removeprefix(files.BOM))]
                except json.JSONDecodeError:
                    continue
                found = []
                if not isinstance(waiting[0], dict):
                    continue
                while waiting:
                    here = waiting.pop()
                    if isinstance(here, dict):
                        named = next((here[k] for k in ("target_id", "id", "target") if here.get(k) not in (None, "", [])), None)
                        if isinstance(named, str):
                            found.append((BATCH.index(path), len(found), named, json.dumps(here, ensure_ascii=False)))
                        waiting += reversed(here.values())
                    elif isinstance(here, list):
                        waiting += reversed(here)
                yield pd.DataFrame(found, columns=["report", "no", "id", "entry"])

    rows = docs.where(F.col("path").isin(*BATCH) & F.col("readable")).select("path", "value").mapInPandas(walk, "report long, no long, id string, entry string")
    return rows.groupBy("id").agg(F.min_by("entry", F.struct("report", "no")).alias("entry"))


def folders(docs: DataFrame) -> DataFrame:
    """dir, path, rel: every file under each folder above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = docs.where(F.col("path").contains("/")).select("path", F.explode(above).alias("dir"))
    return rows.select("dir", "path", F.expr("substring(path, length(dir) + 2)").alias("rel"))


def experiment_folders(targets: DataFrame, below: DataFrame) -> DataFrame:
    """target_id, exp_dir: the configured folder, else '<id>-roundtrip', else the first that contains the id, else the second although it isn't there."""
    direct = F.concat(F.lit(f"{EXPERIMENTS}/"), "target_id", F.lit("-roundtrip"))
    there = below.select(F.col("dir").alias("exp_dir")).distinct()
    asked = targets.select("target_id", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("configured").alias("exp_dir")), F.struct(F.lit(2).alias("p"), direct.alias("exp_dir")))).alias("c")).select("target_id", "c.*")
    exact = asked.join(there, "exp_dir").groupBy("target_id").agg(F.min_by("exp_dir", "p").alias("exact"))
    children = there.where(F.col("exp_dir").rlike(f"^{EXPERIMENTS}/[^/]+$")).select(F.col("exp_dir").alias("path"))
    rest = targets.select("target_id").join(exact, "target_id", "left_anti").withColumn("configured", F.lit(None).cast("string"))
    containing = lookup.resolve_directory(rest, children, excluded=PILOTS).withColumnRenamed("path", "containing")
    return targets.select("target_id").join(exact, "target_id", "left").join(containing, "target_id", "left").select("target_id", F.coalesce("exact", "containing", direct).alias("exp_dir"))


def holdings(dirs: DataFrame, below: DataFrame, docs: DataFrame) -> DataFrame:
    """What each target's folder holds: paths and texts of its documents, sizes of its sources. One aggregation by target."""
    held = dirs.join(below.withColumnRenamed("dir", "exp_dir"), "exp_dir").join(docs, "path")
    held = held.withColumn("parts", F.split("path", "/")).withColumn("doc", F.when(F.col("rel").endswith(".json"), _object(read_text())))
    held = held.withColumn("lines", text.line_count("value")).withColumn("chars", F.length("value").cast("bigint"))
    rel, there = F.col("rel"), F.col("doc").isNotNull()
    nothing = F.array().cast("array<string>")

    def first(value: Column, *ranks: tuple[Column, Column]) -> Column:
        """The value of the row of least (rank, path); a rank holds where its condition does."""
        order = F.lit(None).cast("struct<p:int,parts:array<string>>")
        for number, (condition, parts) in reversed(list(enumerate(ranks))):
            order = F.when(condition, F.struct(F.lit(number).alias("p"), parts.alias("parts"))).otherwise(order)
        return F.min_by(value, order)

    def named(*names: str, only: Column | None = None) -> list[tuple[Column, Column]]:
        return [((rel == n) if only is None else (rel == n) & only, nothing) for n in names]

    like_evaluation = there & (F.try_variant_get("doc", "$.overall_pass", "variant").isNotNull() | _is_object(F.try_variant_get("doc", "$.stages", "variant")))
    evaluation = first(F.struct("path", "value"), *named(*EVALUATIONS, only=there), (like_evaluation, F.col("parts")))
    counted = ~((F.col("value") == "") & (F.col("bytes") > 0))
    size = lambda c: F.struct(F.sum(F.when(c & counted, F.col("lines"))).alias("loc"), F.sum(F.when(c & counted, F.col("chars"))).alias("chars"))
    source = rel.startswith(GENERATED) & files.has_suffix("path")
    report = F.when(rel.endswith(".md"), text.overall_from_markdown("value"))
    return held.groupBy("target_id").agg(
        evaluation.alias("evaluation"),
        first(F.col("path"), *named(*FAILURES), (files.base_name("path") == files_base(FAILURES[0]), F.col("parts"))).alias("failure_path"),
        *(first(F.col("value"), *named(*(n.format(stem) for n in METADATA), only=there)).alias(f"{kind}_metadata") for kind, stem in (("design", "design_generation"), ("code", "code_regeneration"))),
        first(F.col("value"), *named(*NORMALIZATION, only=there)).alias("normalization"),
        first(F.col("value"), *named(RESPONSE, only=there)).alias("response"),
        size(rel == SPAN_BACKUP).alias("span_backup"),
        size(rel == SPAN_INPUT).alias("span_input"),
        size(rel.startswith(TREE_BACKUP)).alias("tree_backup"),
        size(rel.startswith(TREE_GENERATED)).alias("tree_generated"),
        size(source).alias("sources_generated"),
        size(rel == LEGACY_ORIGINAL).alias("legacy_original"),
        size(rel == LEGACY_GENERATED).alias("legacy_generated"),
        size(rel.startswith("backup/")).alias("legacy_backup_tree"),
        size(rel.startswith(GENERATED)).alias("legacy_generated_tree"),
        first(F.struct(F.col("path"), report.alias("passed")), (report.isNotNull(), F.col("parts"))).alias("report"),
    )


def files_base(name: str) -> str:
    return name.rsplit("/", 1)[-1]


def _told(stage: str) -> dict[str, Column]:
    """What the evaluation tells of a stage, as text."""
    at = lambda *keys: coerce.first_nonempty(*(_get("evaluation_doc", f"stages.{stage}.{k}") for k in keys))
    places = {
        "skipped": ("skipped",), "passed": ("passed",), "word": ("status", "result"), "exit_code": ("exit_code",), "timed_out": ("timed_out", "timeout"), "elapsed_seconds": ("elapsed_seconds", "duration_seconds"),
        "tests_ran": ("tests_ran", "ran", "total"), "tests_passed": ("tests_passed", "passed_count"), "tests_failed": ("tests_failed", "failed_count"), "stdout_log": ("stdout_log",), "stderr_log": ("stderr_log",),
    }
    return {f"told_{stage}_{n}": at(*keys) for n, keys in places.items()} | {f"told_{stage}_present": _is_object(F.try_variant_get("evaluation_doc", f"$.stages.{stage}", "variant"))}


def _stage_columns(stage: str) -> dict[str, Column]:
    """The columns of one evaluated stage, of what was told of it, and its logs."""
    told = lambda n: F.col(f"told_{stage}_{n}")
    kinds = {"exit_code": coerce.coerce_int, "timed_out": coerce.coerce_bool, "elapsed_seconds": coerce.coerce_float, "tests_ran": coerce.coerce_int, "tests_passed": coerce.coerce_int, "tests_failed": coerce.coerce_int}
    status = coerce.stage_status(coerce.coerce_bool(told("skipped")), coerce.coerce_bool(told("passed")), told("word"), told("present"))
    return {f"{stage}_status": status} | {f"{stage}_{n}": kind(told(n)) for n, kind in kinds.items()} | {f"{stage}_{n}": told(n) for n in ("stdout_log", "stderr_log")}


def _targets(docs: DataFrame) -> DataFrame:
    """The configurations: config_path, config (variant), target_id, configured folder."""
    inside = docs.where(F.col("path").rlike(f"^{CONFIGS}/[^/]+\\.json$") & ~F.col("path").endswith(".draft.json"))
    read = files.json_objects_strict(inside.withColumn("value", F.regexp_replace(read_text(), "^" + files.BOM, "")))
    stem = F.regexp_replace(files.base_name("path"), r"\.json$", "")
    named = read.select(F.col("path").alias("config_path"), F.col("doc").alias("config"), coerce.first_nonempty(F.try_variant_get("doc", "$.target_id", "string"), stem).alias("target_id"))
    folder = coerce.first_nonempty(_get("config", "experiment_directory", "paths.experiment_directory"), _get("config", "experiment_dir", "paths.experiment_dir"))
    return named.withColumn("configured", F.btrim(F.replace(folder, F.lit("\\"), F.lit("/")), F.lit("/")))


def _original_size(granularity: Column) -> Column:
    """struct(loc, chars, scope) of the original, at the granularity of the output where that was saved."""
    made = lambda column, scope: F.struct(F.col(f"{column}.loc").alias("loc"), F.col(f"{column}.chars").alias("chars"), F.lit(scope).alias("scope"))
    has = lambda column: F.col(f"{column}.loc").isNotNull()
    span = F.coalesce(granularity == "class_span", F.lit(False))
    return (
        F.when(span & has("span_backup"), made("span_backup", "class_span_backup"))
        .when(span & has("span_input"), made("span_input", "class_span_design_input_fallback"))
        .when((granularity == "module_files") & has("tree_backup"), made("tree_backup", "module_files_backup"))
        .when(has("tree_backup"), made("tree_backup", "whole_source_files_fallback"))
    )


def _generated_size() -> Column:
    """struct(loc, chars) of the generated code: saved files, saved sources, or the reply, unless that was cut short."""
    body = F.when(F.col("reply").rlike(r"\S"), text.strip_fence("reply"))
    of_reply = F.when(body.isNotNull() & ~F.coalesce(F.col("code_done_reason") == "length", F.lit(False)), F.struct(text.line_count(body).alias("loc"), F.length(body).cast("bigint").alias("chars")))
    return F.when(F.col("tree_generated.loc").isNotNull(), F.col("tree_generated")).when(F.col("sources_generated.loc").isNotNull(), F.col("sources_generated")).otherwise(of_reply)


def _stage_log(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """target_id, log: the text of the stage that a failure would be blamed on, stderr before stdout; each below the root or else below the target's folder."""
    timed = F.coalesce(*(F.when(F.col(f"{s}_timed_out"), F.lit(s)) for s in STAGES))
    failed = F.coalesce(*(F.when(F.col(f"{s}_status") == "failed", F.lit(s)) for s in STAGES[2:]))
    blamed = rows.withColumn("stage", F.coalesce(timed, failed))
    parts = []
    for number, side in enumerate(("stderr", "stdout")):
        name = F.coalesce(*(F.when(F.col("stage") == s, F.col(f"{s}_{side}_log")) for s in STAGES[2:]))
        found = files.first_candidates(blamed.withColumn("log_name", F.nullif(name, F.lit(""))).where("log_name is not null").withColumn("at", F.array(F.col("log_name"), F.concat_ws("/", "exp_dir", "log_name"))), docs, "target_id", "at")
        parts.append(found.select("target_id", F.lit(number).alias("number"), "value"))
    both = parts[0].unionByName(parts[1]).groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("parts"))
    return both.select("target_id", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("log"))


def standard_records(docs: DataFrame, prefixes: Sequence[tuple[str, str]] = (), stopped: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Records of all configured targets. prefixes: repository by the target id's beginning. stopped: for a target id the category and text (with {exit_code}, {elapsed_seconds}) of a direct test that was stopped from outside."""
    targets = _targets(docs)
    below = folders(docs)
    dirs = experiment_folders(targets, below)
    target_rows = manifest_rows(docs, TARGETS_CSV).select("no", F.col("row").alias("target_row"), *(F.try_element_at("row", F.lit(k)).alias(k) for k in ("target_id", "id", "target")))
    run_rows = manifest_rows(docs, RUNS_CSV).select("no", F.col("row").alias("run_row"), *(F.try_element_at("row", F.lit(k)).alias(f"run_key_{k}") for k in ("run_id", "id", "run")))
    rows = targets.join(dirs, "target_id").withColumn("run_id", coerce.first_nonempty(F.try_variant_get("config", "$.run_id", "string"), F.concat("target_id", F.lit("-unknown-run"))))
    held = holdings(dirs, below, docs)
    rows = lookup.first_match(rows.join(held, "target_id", "left"), target_rows.withColumnsRenamed({"target_id": "key_target_id", "id": "key_id", "target": "key_target"}), "target_id", ["key_target_id", "key_id", "key_target"], "no", ["target_row"])
    rows = lookup.first_match(rows, run_rows, "run_id", ["run_key_run_id", "run_key_id", "run_key_run"], "no", ["run_row"])
    rows = rows.join(batch_entries(docs).select(F.col("id").alias("target_id"), "entry"), "target_id", "left")
    failure_docs = docs.select(F.col("path").alias("failure_path"), read_text().alias("failure_text"))
    rows = rows.join(failure_docs, "failure_path", "left")
    rows = rows.withColumns({"evaluation_doc": _object("evaluation.value"), "failure_doc": _object("failure_text"), "batch_doc": F.try_parse_json("entry"), "response_doc": _object("response")})
    rows = rows.withColumns({"design_doc": _object("design_metadata"), "code_doc": _object("code_metadata"), "own_normalization": F.try_variant_get("evaluation_doc", "$.code_regeneration_normalization", "variant")})
    rows = rows.withColumn("normalization_doc", F.when(_is_object(F.col("own_normalization")), F.col("own_normalization")).otherwise(_object("normalization")))
    rows = cut(rows.drop("own_normalization", "normalization", "design_metadata", "code_metadata", "response", "entry"), "documents")  # parsed once; a small row a target

    # first texts, then values of them: each step is written, a small row a target, so that no plan repeats the steps before it
    listed = lambda *paths: F.coalesce(_get("config", *paths, kind="array<string>"), F.array().cast("array<string>"))
    first, reasons = coerce.first_nonempty, ("error", "message", "reason", "detail")
    told = {
        "config_repository": first(_get("config", "repository", "repository_name", "project.repository"), _of_row("target_row", "repository", "repository_name", "project")),
        "config_name": first(_get("config", "target_name", "name", "symbol"), _of_row("target_row", "target_name", "name", "symbol")),
        "granularity": first(_get("config", "granularity"), _of_row("target_row", "granularity")),
        "source_list": listed("source_files", "design_input.source_files"), "test_list": listed("test_files", "evaluation.test_files"),
        **{n: first(_get("config", f"evaluation.{n}"), _of_row("target_row", n)) for n in ("expected_direct_tests", "expected_full_tests")},
        **{n: _get("config", f"model.{n}") for n in ("num_ctx", "num_predict")},
        **{f"{k}_{n}": _get(f"{k}_doc", n) for k in ("design", "code") for n in ("done_reason", "prompt_eval_count", "eval_count")},
        **{f"{k}_present": F.col(f"{k}_doc").isNotNull() for k in ("design", "code", "evaluation", "failure")},
        **{f"{k}_error": first(_get(f"{k}_doc", "error"), _get(f"{k}_doc", "error_message")) for k in ("design", "code")},
        **{n: _get("normalization_doc", n) for n in ("normalization_applied", "strict_format_pass", "retry_performed", "automatic_repair_performed", "normalization_type")},
        **{n: _get("evaluation_doc", f"restoration.{n}") for n in ("restored", "repository_clean")},
        "evaluated": _get("evaluation_doc", "overall_pass"),
        "otherwise": first(_get("batch_doc", "overall_pass", "passed"), _get("batch_doc", "status", "result"), _of_row("run_row", "overall_pass", "passed", "status", "result")),
        "pipeline_stage": _get("failure_doc", "stage", "failure_stage"), "pipeline_reason": _get("failure_doc", *reasons),
        "other_stage": first(_get("batch_doc", "failure_stage", "stage"), _of_row("run_row", "failure_stage", "stage")), "other_reason": first(_get("batch_doc", *reasons), _of_row("run_row", *reasons)),
        "reply": coerce.response_text("response_doc"), **{k: v for s in STAGES[2:] for k, v in _told(s).items()},
    }
    documents = ("config", "evaluation_doc", "design_doc", "code_doc", "normalization_doc", "batch_doc", "response_doc", "failure_doc", "target_row", "run_row")
    rows = cut(rows.withColumns(told).drop(*documents), "told")
    numbers = ("expected_direct_tests", "expected_full_tests", "num_ctx", "num_predict", *(f"{k}_{n}" for k in ("design", "code") for n in ("prompt_eval_count", "eval_count")))
    truths = ("normalization_applied", "strict_format_pass", "retry_performed", "automatic_repair_performed", "restored", "repository_clean", "evaluated", "otherwise")
    values = {
        "repository": first("config_repository", coerce.repository_of("target_id", prefixes)), "target_name": first("config_name", coerce.name_of("target_id", [p for p, _ in prefixes])),
        "experiment_directory": F.col("exp_dir"), "legacy_format": F.lit(False), "result_source": F.coalesce("evaluation.path", F.lit("batch/manifests fallback")),
        "source_files": F.array_join("source_list", "; "), "test_files": F.array_join("test_list", "; "), **{n: coerce.coerce_int(n) for n in numbers}, **{n: coerce.coerce_bool(n) for n in truths},
        "told_stage": first("pipeline_stage", "other_stage"), "told_detail": first("pipeline_reason", "other_reason"),
    }
    for kind, stage in (("design", STAGES[0]), ("code", STAGES[1])):
        values[f"{stage}_status"] = coerce.generation_status(F.col(f"{kind}_present"), F.coalesce(f"{kind}_done_reason", F.lit("")), F.col(f"{kind}_error"))
        values |= {f"{stage}_{a}": F.lit(None).cast(t) for a, t in STAGE_KINDS.items()}
    for stage in STAGES[2:]:
        values |= _stage_columns(stage)
    rows = cut(rows.withColumns(values).drop(*(n for n in told if n.startswith("told_") and n not in values)), "values")

    any_failed = F.greatest(*(F.coalesce(F.col(f"{s}_status") == "failed", F.lit(False)) for s in STAGES))
    verdict = coerce.overall_ladder(F.col("evaluated"), F.col("otherwise"), F.lit(None).cast("boolean"), F.col("full_test_status"), F.col("failure_present") | any_failed)
    rows = rows.withColumns({"overall_pass": verdict, "original": _original_size(F.col("granularity")), "generated": _generated_size()})
    rows = cut(rows, "verdicts")
    configured = files.configured_sizes(
        rows.select("target_id", F.transform("source_list", lambda f: F.concat(F.lit("repos/"), F.col("repository"), F.lit("/"), f)).alias("at")), docs.select("path", "value"), "target_id", "at"
    ).select("target_id", F.col("loc").alias("configured_loc"), F.col("chars").alias("configured_chars"))
    rows = rows.join(configured, "target_id", "left").join(_stage_log(rows, docs), "target_id", "left")
    unsaved = F.col("original.loc").isNull() & F.col("configured_loc").isNotNull()
    rows = rows.withColumns({
        "original_loc": F.coalesce("original.loc", "configured_loc"), "original_chars": F.coalesce("original.chars", "configured_chars"),
        "original_measurement_scope": F.when(unsaved, "whole_source_files_repository_fallback").otherwise(F.col("original.scope")), "generated_loc": F.col("generated.loc"), "generated_chars": F.col("generated.chars"),
        "data_quality_notes": F.concat_ws(" | ", F.when(unsaved, NO_SPAN), F.when(~F.col("evaluation_present"), NO_EVALUATION), F.when(F.col("failure_path").isNotNull(), F.concat(F.lit("Pipeline failure file: "), "failure_path")), F.when(F.col("overall_pass").isNull(), NO_RESULT)),
    })

    return _finished(_blamed(cut(rows, "sized"), stopped or {}))


def _blamed(rows: DataFrame, stopped: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows with the stage, category and detail of their failure."""
    blank = F.lit(None).cast("string")
    row = {"overall_pass": F.col("overall_pass"), "design_reason": F.col("design_done_reason"), "code_reason": F.col("code_done_reason"), "failure_present": F.col("failure_present"),
        "failure_stage": F.col("pipeline_stage"), "detail": F.col("told_detail"), "told_stage": F.col("told_stage"), "direct_test_elapsed": F.col("direct_test_elapsed_seconds")}
    row["failure_message"] = coerce.first_nonempty("pipeline_reason", F.left(F.col("failure_text"), F.lit(500)))
    for s in STAGES:
        row |= {f"{s}_status": F.col(f"{s}_status"), f"{s}_timed_out": F.col(f"{s}_timed_out"), f"{s}_exit": F.col(f"{s}_exit_code"), f"{s}_ran": F.coalesce(f"{s}_tests_ran", f"{s}_tests_passed", f"{s}_tests_failed")}
    category = F.coalesce(*(F.when(F.col("target_id") == k, F.lit(v[0])) for k, v in stopped.items()), blank)
    filled = lambda words: F.replace(F.replace(F.lit(words), F.lit("{exit_code}"), F.col("direct_test_exit_code").cast("string")), F.lit("{elapsed_seconds}"), F.col("direct_test_elapsed_seconds").cast("string"))
    words = F.coalesce(*(F.when(F.col("target_id") == k, filled(v[1])) for k, v in stopped.items()), blank)
    rows = rows.withColumn("blame", classify.classify(row, STAGES, F.col("log"), category, words))
    return rows.withColumns({"failure_stage": F.col("blame.stage"), "failure_category": F.col("blame.category"), "failure_detail": F.coalesce(F.nullif(F.col("blame.detail"), F.lit("")), "told_detail")})


def _finished(rows: DataFrame) -> DataFrame:
    elapsed = [F.col(f"{s}_elapsed_seconds") for s in STAGES]
    total = F.aggregate(F.array_compact(F.array(*elapsed)), F.lit(0.0), lambda s, x: s + x)
    made = {"result": coerce.result_label("overall_pass"), "failure_category_ja": classify.label("failure_category"), "total_recorded_elapsed_seconds": F.when(F.coalesce(*elapsed).isNotNull(), total),
        "generated_original_loc_ratio": F.when(F.col("original_loc") > 0, ratio("generated_loc", "original_loc"))}
    return rows.withColumns(made).select(*COLUMNS)


def legacy_record(docs: DataFrame, legacy: Legacy) -> DataFrame:
    """The record of a target without a configuration; no row where its folder isn't there."""
    folder = f"{EXPERIMENTS}/{legacy.directory}"
    below = folders(docs).where(F.col("dir") == folder)
    dirs = below.select(F.lit(legacy.target_id).alias("target_id"), F.col("dir").alias("exp_dir")).distinct()
    rows = holdings(dirs, below, docs).withColumn("evaluation_doc", _object("evaluation.value"))
    evaluated = coerce.coerce_bool(_get("evaluation_doc", "overall_pass", "passed", "status", "result"))
    known = F.coalesce(evaluated, F.col("report.passed"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.withColumns({"overall_pass": F.coalesce(known, F.lit(legacy.overall_pass)), "known": known.isNotNull(), "result_source": F.when(evaluated.isNotNull(), F.col("evaluation.path")).when(known.isNotNull(), F.col("report.path")).otherwise("legacy fallback")})
    body, made = F.col("legacy_original.loc").isNotNull(), F.col("legacy_generated.loc").isNotNull()
    side = lambda c, one, two, n: F.when(c, F.col(f"{one}.{n}")).otherwise(F.col(f"{two}.{n}"))
    ok = F.col("overall_pass")
    values = {
        "run_id": F.lit(legacy.run_id), "repository": F.lit(legacy.repository), "target_name": F.lit(legacy.target_name), "experiment_directory": F.lit(folder), "config_path": none("string"),
        "legacy_format": F.lit(True), "granularity": F.lit(legacy.granularity), "source_files": F.lit(""), "test_files": F.lit(""),
        "expected_direct_tests": F.lit(legacy.expected_direct_tests).cast("bigint"), "expected_full_tests": F.lit(legacy.expected_full_tests).cast("bigint"),
        **{n: none("bigint") for n in ("num_ctx", "num_predict", "design_prompt_eval_count", "design_eval_count", "code_prompt_eval_count", "code_eval_count")},
        **{n: none("string") for n in ("design_done_reason", "code_done_reason", "normalization_type", "failure_stage", "failure_detail")},
        **{n: none("boolean") for n in ("normalization_applied", "strict_format_pass", "retry_performed", "automatic_repair_performed", "restored", "repository_clean")},
        "failure_category": F.when(ok, "none").otherwise("unknown_failure"), "original_measurement_scope": F.when(body, "function_body_backup").otherwise("legacy_backup_tree_fallback"),
        **{f"original_{n}": side(body, "legacy_original", "legacy_backup_tree", n) for n in ("loc", "chars")}, **{f"generated_{n}": side(made, "legacy_generated", "legacy_generated_tree", n) for n in ("loc", "chars")},
        "data_quality_notes": F.concat_ws(" | ", F.when(~F.col("known"), NO_STANDARD), F.when(~body, NO_BODY), F.when(~made, NO_GENERATED)),
    }
    for stage in STAGES:
        status = F.when(ok, "passed").otherwise("not_recorded") if stage in STAGES[2:] else F.lit("not_recorded")
        values |= {f"{stage}_status": status, **{f"{stage}_{a}": none(t) for a, t in STAGE_KINDS.items()}}
    return _finished(rows.withColumns(values))


def pilot_records(docs: DataFrame) -> DataFrame:
    """Records of the pilots that failed: a folder each, judged by their evaluation and pipeline failure alone."""
    root = f"{EXPERIMENTS}/{PILOTS}"
    below = folders(docs).where(F.col("dir").rlike(f"^{root}/[^/]+$"))
    name = F.substring_index("exp_dir", "/", -1)
    dirs = below.select(F.col("dir").alias("exp_dir")).distinct().select(F.concat(F.lit("pilot::"), name).alias("target_id"), "exp_dir")
    failure = docs.select(F.col("path").alias("failure_path"), read_text().alias("failure_text"))
    rows = dirs.join(holdings(dirs, below, docs), "target_id").join(failure, "failure_path", "left").withColumns({"evaluation_doc": _object("evaluation.value"), "failure_doc": _object("failure_text")})
    rows = rows.withColumns({"failure_present": F.col("failure_doc").isNotNull(), "pipeline_stage": _get("failure_doc", "stage", "failure_stage"), "pipeline_reason": _get("failure_doc", "error", "message", "reason", "detail"), "evaluated": _get("evaluation_doc", "overall_pass")}).drop("failure_doc")
    none = lambda kind: F.lit(None).cast(kind)
    texts = ("config_path", "granularity", "design_done_reason", "code_done_reason", "normalization_type", "original_measurement_scope", "told_stage", "told_detail", "log")
    numbers = ("expected_direct_tests", "expected_full_tests", "num_ctx", "num_predict", "design_prompt_eval_count", "design_eval_count", "code_prompt_eval_count", "code_eval_count", "original_loc", "original_chars", "generated_loc", "generated_chars")
    truths = ("normalization_applied", "strict_format_pass", "retry_performed", "automatic_repair_performed", "restored", "repository_clean")
    values = {
        "run_id": F.col("target_id"), "repository": F.lit(PILOTS), "target_name": name, "experiment_directory": F.col("exp_dir"), "legacy_format": F.lit(True),
        "result_source": F.coalesce("evaluation.path", F.lit("pilot failure")), "source_files": F.lit(""), "test_files": F.lit(""), "data_quality_notes": F.lit(""),
        "overall_pass": F.coalesce(coerce.coerce_bool("evaluated"), F.lit(False)), **{n: none("string") for n in texts}, **{n: none("bigint") for n in numbers}, **{n: none("boolean") for n in truths},
    }
    for stage in STAGES:
        values |= {f"{stage}_status": F.lit("not_recorded"), **{f"{stage}_{a}": none(t) for a, t in STAGE_KINDS.items()}}
    return _finished(_blamed(rows.withColumns(values), {}))


def records(spark: SparkSession, root: str, prefixes: Sequence[tuple[str, str]] = (), stopped: Mapping[str, tuple[str, str]] | None = None, legacy: Legacy | None = None, pilots: bool = False) -> DataFrame:
    """All records of the study below root, in no order (see operators.records.presented)."""
    docs = cut(artefacts(prepare(spark), root), "artefacts")  # read by every lookup
    parts = [standard_records(docs, prefixes, stopped)]
    if legacy is not None:
        parts.append(legacy_record(docs, legacy))
    if pilots:
        parts.append(pilot_records(docs))
    return union_records(*parts)

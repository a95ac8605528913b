"""The analysis of records: summary, tables and the report set."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialytics.operators import classify, funnel, groups, quant, records, validate
from trialytics.schemas import METRICS, STAGES, stage_dimension
from trialytics.session import cut, free
from trialytics.sinks import reports

# Columns of the failure report, and titles of the tables for print.
FAILURE_COLUMNS = ("target_id", "repository", "target_name", "failure_stage", "failure_category", "failure_category_ja", "failure_detail", "design_done_reason", "code_done_reason", "normalization_applied")
PRINT_TITLE = "# 論文掲載用集計表"
PRINT_TABLES = ("## 表A　対象別の主実験結果", "## 表B　リポジトリ別結果", "## 表C　粒度別結果", "## 表D　粒度間の探索的比較", "## 表E　失敗原因別件数")
SPAN, MODULE = "class_span", "module_files"
INFERENCE_NOTE = "Exploratory only: targets are few and not guaranteed to be independent."
#: Beginnings of messages that stop an analysis.
FATAL = ("unknown overall result", "duplicate", "retry or repair recorded")


#: The summary's counters, by the part of it that they stand in.
COUNTERS = {
    "normalization": ("records_with_metadata", "normalization_applied", "normalization_applied_and_passed", "strict_format_failures"),
    "generation": ("done_reason_length_count", "design_stop_count", "code_stop_count"),
    "data_quality": ("legacy_record_count", "missing_original_loc_count", "missing_generated_loc_count"),
}


def counts(rows: DataFrame) -> DataFrame:
    """kind, key, value, n: all that the summary counts of wide records, in one scan and one shuffle.

    Kinds: overall, repository, granularity, failure_stage and failure_category by outcome
    (passed, failed or unknown), stage by status, and COUNTERS, whose key is the counter.
    """
    c = F.col
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    outcome = F.when(c("overall_pass"), "passed").when(~c("overall_pass"), "failed").otherwise("unknown")
    met = {
        "records_with_metadata": c("normalization_applied").isNotNull(), "normalization_applied": flag("normalization_applied"), "normalization_applied_and_passed": flag("normalization_applied") & c("overall_pass"), "strict_format_failures": ~c("strict_format_pass"),
        "done_reason_length_count": (c("design_done_reason") == "length") | (c("code_done_reason") == "length"), "design_stop_count": c("design_done_reason") == "stop", "code_stop_count": c("code_done_reason") == "stop",
        "legacy_record_count": flag("legacy_format"), "missing_original_loc_count": c("original_loc").isNull(), "missing_generated_loc_count": c("generated_loc").isNull(),
    }
    one = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    of = [("overall", F.lit("")), *((n, groups.group_key(n)) for n in ("repository", "granularity")), *((n, F.coalesce(n, F.lit("none"))) for n in ("failure_stage", "failure_category"))]
    told = [one(kind, key, outcome) for kind, key in of]
    told += [one("stage", F.lit(s), F.coalesce(f"{s}_status", F.lit("not_recorded"))) for s in STAGES]
    told += [F.when(met[name], one(kind, F.lit(name), F.lit("met"))) for kind, names in COUNTERS.items() for name in names]
    return rows.select(F.explode(F.array_compact(F.array(*told))).alias("t")).groupBy("t.kind", "t.key", "t.value").agg(F.count("*").alias("n"))


def tables(rows: DataFrame, counted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lazy result tables of wide records. counted: counts(rows), if they are at hand."""
    counted = counts(rows) if counted is None else counted
    passed, spark, c = F.col("overall_pass"), rows.sparkSession, F.col
    kind = lambda *names: counted.where(c("kind").isin(*names))
    ok = c("value") == "passed"  # an unknown outcome neither passed nor failed
    judged = kind("repository", "granularity").withColumns({"value": F.when(c("value") != "unknown", c("value"))})
    met = lambda part: counted.agg(*(F.coalesce(F.sum(F.when((c("kind") == part) & (c("key") == name), c("n"))), F.lit(0)).alias(name) for name in COUNTERS[part]))
    failures = lambda name: kind(name).where("value = 'failed'").select("key", "n")
    stages = kind("stage").select(c("key").alias("stage"), c("value").alias("status"), "n")
    overall = counted.withColumn("n", F.when(c("kind") == "overall", c("n")).otherwise(0)).withColumn("value", F.when(c("value") != "unknown", c("value")))
    return {
        "overall": groups.rates_of_counts(overall, (), "n", ok),
        "group_statistics": groups.rates_of_counts(judged, ("kind", "key"), "n", ok).withColumnsRenamed({"kind": "dimension", "key": "group"}).orderBy(F.desc("dimension"), "group"),
        "stage_funnel": funnel.stage_funnel(stages, stage_dimension(spark), "n").orderBy("stage_order").select("stage", "reached", "passed", "failed", "skipped", "not_recorded_or_unknown"),
        "failure_stages": failures("failure_stage").orderBy("key"),
        "failure_categories": failures("failure_category").orderBy(F.desc("n"), "key"),
        "quantitative": quant.metrics_by_outcome(rows, METRICS, passed),
        "inferential": quant.two_by_two(judged.where("kind = 'granularity'"), c("key"), SPAN, MODULE, ok, "n"),
        **{part: met(part) for part in COUNTERS},
        "validation": validate.violations(rows, "target_id", validate.record_rules()).unionByName(validate.duplicate_keys(rows, "target_id")),
        "failures": rows.where(passed == F.lit(False)).select(*FAILURE_COLUMNS),
    }


def summary(rows: DataFrame) -> dict:
    """The summary document. The rows are scanned once for all counts, which are few and written, and again for the metrics and the rules."""
    counted = cut(counts(rows), "counts")
    made = {name: reports.rows_as_json(df) for name, df in tables(rows, counted).items() if name != "failures"}
    free(counted)
    one = lambda name: made[name][0] if made[name] else {}
    counted = lambda name: {r["key"]: r["n"] for r in sorted(made[name], key=lambda r: r["key"])}
    metrics = {r["metric"]: {"n": r["n"], **{k: r[k] for k in ("pass_mean", "pass_median", "fail_mean", "fail_median")}, "point_biserial_r": r["point_biserial"], "spearman_rho": r["spearman"]} for r in made["quantitative"]}
    test = one("inferential")
    compared = {f"{SPAN}_vs_{MODULE}_fisher_two_sided_p": test["fisher_p"], f"{SPAN}_table": [test["a"], test["b"]], f"{MODULE}_table": [test["c"], test["d"]]} if test else {}
    issues = [f"{r['target_id']}: {r['message']}" for r in sorted(made["validation"], key=lambda r: (r["rule_no"], r["target_id"] or ""))]
    return {
        "schema_version": "1.0", "generated_at_utc": reports.utc_now(), "overall": one("overall"), "group_statistics": made["group_statistics"], "stage_funnel": made["stage_funnel"],
        "failure_stage_counts": counted("failure_stages"), "failure_category_counts": counted("failure_categories"), "normalization": one("normalization"), "generation": one("generation"),
        "quantitative_analysis": {m: metrics[m] for m in METRICS if m in metrics}, "inferential_analysis": {"note": INFERENCE_NOTE, **compared},
        "data_quality": {"validation_issue_count": len(issues), "validation_issues": issues, **one("data_quality")},
    }


def _grid(headers: list[str], lines: list[list]) -> str:
    cell = lambda v: "—" if v is None or v == "" else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in [headers, ["---"] * len(headers), *lines])


def print_tables(rows: DataFrame, made: dict) -> str:
    """The tables for print, in Markdown. rows: in presentation order."""
    share = lambda v: "—" if v is None else f"{v * 100:.1f}%"
    listed = rows.select("no", "repository", "target_name", "granularity", "expected_direct_tests", "expected_full_tests", "result", "failure_stage", F.when(~F.coalesce("overall_pass", F.lit(False)), F.col("failure_category_ja")).alias("cause"))
    of = lambda dimension: [[r["group"], r["total"], r["passed"], r["failed"], share(r["pass_rate"])] for r in made["group_statistics"] if r["dimension"] == dimension]
    test = made["inferential_analysis"]
    left, right = test.get(f"{SPAN}_table", [None, None]), test.get(f"{MODULE}_table", [None, None])
    p = test.get(f"{SPAN}_vs_{MODULE}_fisher_two_sided_p")
    causes = sorted(made["failure_category_counts"].items(), key=lambda x: (-x[1], x[0]))
    grids = [
        _grid(["No.", "Repository", "Target", "Granularity", "Direct tests", "Full tests", "Result", "Failure stage", "Failure cause"], [list(r) for r in listed.toLocalIterator()]),
        _grid(["Repository", "N", "PASS", "FAIL", "Pass rate"], of("repository")),
        _grid(["Granularity", "N", "PASS", "FAIL", "Pass rate"], of("granularity")),
        _grid(["Comparison", "Group 1 PASS/FAIL", "Group 2 PASS/FAIL", "Fisher p (two-sided)"], [[f"{SPAN} vs {MODULE}", f"{left[0]}/{left[1]}", f"{right[0]}/{right[1]}", "—" if p is None else f"{p:.4f}"]]),
        _grid(["Failure cause", "Count"], [[classify.LABELS.get(k, k), n] for k, n in causes]),
    ]
    return "\n\n".join([PRINT_TITLE, *(part for pair in zip(PRINT_TABLES, grids, strict=True) for part in pair)]) + "\n"


def write_reports(rows: DataFrame, folder: str, svg: bool = True, root: str | None = None) -> list[dict]:
    """Write the report set to a folder of the driver; its files are returned, and listed in the manifest, which is written last."""
    os.makedirs(os.path.join(folder, "figures") if svg else folder, exist_ok=True)
    ordered = cut(records.presented(rows), "presented").orderBy("no")
    plain = ordered.drop("no").orderBy(F.lower("repository"), F.lower("target_id"))
    made = summary(ordered.drop("no"))
    parts = tables(plain)
    at = lambda name: os.path.join(folder, name)
    files = ["main_results.csv", "main_results.json", "summary.json", "summary.md", "thesis_tables.md", "failure_analysis.csv", "group_statistics.csv", "stage_funnel.csv"]
    reports.write_csv(plain, at("main_results.csv"))
    reports.write_json({"records": reports.rows_as_json(plain)}, at("main_results.json"))
    reports.write_json(made, at("summary.json"))
    reports.write_csv(parts["failures"].orderBy(F.lower("repository"), F.lower("target_id")), at("failure_analysis.csv"))
    for name in ("group_statistics", "stage_funnel"):
        reports.write_csv(parts[name], at(f"{name}.csv"))
    sections = "\n".join(f"## {name}\n\n{reports.markdown_table(df)}" for name, df in parts.items() if name != "failures")
    charts = {}
    if svg:
        rates = [(r["group"], round(r["pass_rate"] * 100, 1)) for r in made["group_statistics"] if r["dimension"] == "repository"]
        causes = sorted(made["failure_category_counts"].items(), key=lambda x: (-x[1], x[0]))
        charts = {
            "figures/overall_result.svg": ("Main-study results", [("PASS", made["overall"]["passed"]), ("FAIL", made["overall"]["failed"])], ""),
            "figures/repository_pass_rate.svg": ("Pass rate by repository", rates, "%"),
            "figures/failure_categories.svg": ("Failure categories", [(classify.LABELS.get(k, k), n) for k, n in causes], ""),
        }
    texts = {"summary.md": "# Summary\n\n" + sections, "thesis_tables.md": print_tables(ordered, made), **{name: reports.svg_bars(*chart) for name, chart in charts.items()}}
    for name, words in texts.items():
        with open(at(name), "w", encoding="utf-8", newline="\n") as out:
            out.write(words)
    listed = reports.manifest((at(f) for f in [*files, *charts]), root)
    about = {"schema_version": "1.0", "project_root": root, "generated_at_utc": reports.utc_now(), "main_target_count": made["overall"]["total"], "output_files": listed, "read_only_analysis": True,
        "external_commands_executed": False, "llm_called": False, "docker_called": False, "tests_called": False}
    reports.write_json(about, at("analysis_manifest.json"))
    return listed


def fatal_issues(rows: DataFrame, expected: tuple[int, int, int] | None = None) -> list[str]:
    """Violations that stop an analysis: duplicate or unknown targets, retries, another summary than expected."""
    found = tables(rows)["validation"].where(F.col("message").isin(*FATAL)).orderBy("rule_no", "target_id")
    issues = [f"{r['target_id']}: {r['message']}" for r in found.toLocalIterator()]
    if expected is not None and (other := validate.unexpected_summary(rows, F.col("overall_pass"), expected).head()):
        issues.append(f"unexpected summary: {tuple(other)}, expected {expected}")
    return issues


def exit_code(rows: DataFrame, expected: tuple[int, int, int] | None = None) -> int:
    """0, or 2 for a fatal violation."""
    return 2 if fatal_issues(rows, expected) else 0

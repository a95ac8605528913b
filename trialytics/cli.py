"""Command line: analyse a study, build its catalogue, show an experiment, plan its batch.

A study's settings are a JSON file: prefixes ([[beginning of a target id, repository], ...]),
stopped ({target id: [category, text]}), legacy (fields of study.Legacy), expected ([total,
passed, failed]), reports ([[part of a report's name, repository], ...]), sources
([[repository, target, source], ...]), targets (their number).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trialytics.operators import catalog
from trialytics.plans import analyze, batch, overview, study
from trialytics.session import build, cut
from trialytics.sinks import reports
from trialytics.sources import files


class StudyError(Exception):
    """The study's artefacts don't fit together."""


def settings(path: str | None) -> dict:
    if path is None:
        return {}
    with open(path, encoding="utf-8-sig") as file:
        return json.load(file)


def run_analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    missing = [p for p in (study.EXPERIMENTS, study.CONFIGS) if not os.path.isdir(os.path.join(args.project_root, p))]
    if missing:
        raise StudyError("the project root lacks " + ", ".join(missing))
    known = settings(args.study)
    legacy = study.Legacy(**known["legacy"]) if "legacy" in known else None
    rows = study.records(spark, args.project_root, [tuple(p) for p in known.get("prefixes", ())], {k: tuple(v) for k, v in known.get("stopped", {}).items()}, legacy, args.include_pilot_failures)
    rows = cut(rows, "records")
    strict = not args.allow_unexpected_summary and not args.include_pilot_failures and "expected" in known
    if issues := analyze.fatal_issues(rows, tuple(known["expected"]) if strict else None):
        raise StudyError("\n".join(issues))
    folder = args.output_dir or os.path.join(args.project_root, "reports", "analysis")
    listed = analyze.write_reports(rows, folder, not args.no_svg, args.project_root)
    print("\n".join(f["path"] for f in listed))
    return 0


def run_bootstrap(spark: SparkSession, args: argparse.Namespace) -> int:
    known = settings(args.study)
    docs = study.artefacts(spark, args.project_root).where(F.col("path").rlike(r"^metadata/[^/]*_report\.md$"))
    if docs.isEmpty():
        raise FileNotFoundError(f"no *_report.md files in {args.project_root}/metadata")
    made = batch.report_records(docs, [tuple(r) for r in known.get("reports", ())], {(r, n): s for r, n, s in known.get("sources", ())})
    kept, excluded = catalog.split_excluded(cut(batch.with_readiness(made), "catalogue"), "adoption_status")
    out = args.output_dir or args.project_root
    drafts, report_dir = os.path.join(out, study.CONFIGS), os.path.join(out, "reports", "batch")
    os.makedirs(drafts, exist_ok=True)
    os.makedirs(report_dir, exist_ok=True)
    order = [F.lower("repository_id"), F.lower("target_name")]
    rows = reports.rows_as_json(kept.orderBy(*order))
    for name in sorted(os.listdir(drafts)):  # stale drafts: readable, not enabled, of no target
        if name.endswith(".draft.json") and name not in {f"{r['target_id']}.draft.json" for r in rows}:
            try:
                stale = settings(os.path.join(drafts, name)).get("enabled") is False
            except json.JSONDecodeError:
                stale = False
            if stale:
                os.remove(os.path.join(drafts, name))
    for row in rows:
        reports.write_json(batch.draft(row), os.path.join(drafts, f"{row['target_id']}.draft.json"))
    expected = known.get("targets", len(rows))
    plain = ("repository_id", "target_id", "target_name", *batch.FIELDS)
    listed = {"schema_version": "2.0", "expected_target_count": expected, "detected_target_count": len(rows), "excluded_targets": reports.rows_as_json(excluded.orderBy(*order).select(*plain)), "targets": [{n: r[n] for n in plain} for r in rows]}
    reports.write_json(listed, os.path.join(out, "configs", "roundtrip", "target_catalog.json"))
    batch.write_readiness(kept, excluded, report_dir, expected)
    print(f"{len(rows)} of {expected} targets")
    return 0 if len(rows) == expected else 2


def run_overview(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = cut(study.artefacts(spark, args.project_root).where(F.col("path").startswith(f"{study.EXPERIMENTS}/{args.experiment}/")), "artefacts")
    rows = reports.rows_as_json(overview.overviews(docs).where(F.col("experiment") == args.experiment))
    if not rows:
        raise FileNotFoundError(f"no experiment {args.experiment}")
    (row,) = rows
    shown = [] if args.no_content else [f["path"] for f in [*row["inputs"], *row["outputs"]] if f["exists"] and not f["path"].endswith(".json")]
    contents = {r["path"]: r["value"] for r in docs.where(F.col("path").isin(*shown)).select("path", "value").orderBy("path").toLocalIterator()} if shown else {}
    folder = os.path.join(args.output_dir or os.path.join(args.project_root, study.EXPERIMENTS, args.experiment, "report"))
    os.makedirs(folder, exist_ok=True)
    row["source_replacement"] = row["source_replacement"] or "{}"
    made = overview.report(row, contents)
    row.pop("experiment")
    row.pop("facts")
    row["source_replacement"] = json.loads(row["source_replacement"])
    reports.write_json({"schema_version": "1.0", "generated_at_utc": reports.utc_now(), **row}, os.path.join(folder, "experiment_overview.json"))
    with open(os.path.join(folder, "experiment_overview.md"), "w", encoding="utf-8", newline="\n") as out:
        out.write(made)
    print(folder)
    return 0


def run_plan(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = study.artefacts(spark, args.project_root)
    found = docs.where(F.col("path").rlike(f"^{study.CONFIGS}/[^/]+\\.json$") & ~F.col("path").endswith(".draft.json"))
    rows = batch.plan(files.json_objects_strict(found.withColumn("value", F.regexp_replace(study.read_text(), "^" + files.BOM, ""))))
    if args.targets:
        wanted = study.manifest_rows(docs, args.targets).select(F.try_element_at("row", F.lit("target_id")).alias("target_id"))
        rows = rows.join(wanted.distinct(), "target_id", "left_semi").orderBy("config")
    folder = args.output_dir or os.path.join(args.project_root, "reports", "batch")
    os.makedirs(folder, exist_ok=True)
    batch.write_batch_report(rows, os.path.join(folder, "batch_plan.json"), os.path.join(folder, "batch_plan.md"))
    print(", ".join(f"{r['status']}={r['count']}" for r in rows.groupBy("status").count().orderBy("status").collect()))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="trialytics", description="Analyses of staged trials.")
    commands = out.add_subparsers(dest="command", required=True)
    for name, run, words in (("analyze", run_analyze, "records, statistics and reports of a study"), ("bootstrap", run_bootstrap, "catalogue and drafts from reports"), ("overview", run_overview, "one experiment in one report"), ("plan", run_plan, "which targets are ready")):
        one = commands.add_parser(name, help=words)
        one.add_argument("--project-root", default=os.getcwd())
        one.add_argument("--output-dir")
        one.add_argument("--study", help="settings of the study (JSON)")
        one.set_defaults(run=run)
        if name == "analyze":
            one.add_argument("--allow-unexpected-summary", action="store_true")
            one.add_argument("--include-pilot-failures", action="store_true")
            one.add_argument("--no-svg", action="store_true")
        if name == "overview":
            one.add_argument("--experiment", required=True, help="folder below experiments/")
            one.add_argument("--no-content", action="store_true")
        if name == "plan":
            one.add_argument("--targets", help="a CSV, relative to the root, with a target_id column")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0; 1 for an error of bootstrap or plan; 2 for artefacts that don't fit; 3 for any other error of analyze."""
    args = parser().parse_args(argv)
    args.project_root = os.path.abspath(args.project_root)
    try:
        return args.run(spark or build(), args)
    except StudyError as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 2
    except Exception as error:  # noqa: BLE001  the exit code tells
        print(f"ERROR: {type(error).__name__}: {error}", file=sys.stderr)
        return 3 if args.command == "analyze" else 1


if __name__ == "__main__":
    raise SystemExit(main())

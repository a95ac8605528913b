"""A small invented study, made by the test: from its artefacts through the command line to records, tables, summary and manifest."""

from __future__ import annotations

import csv
import hashlib
import json

import pytest

from trialytics import cli
from trialytics.plans import study

TREE = "int one() {\n  return 1;\n}\n"
SETTINGS = {"prefixes": [["a-", "Alpha"], ["b-", "Beta"]], "expected": [5, 2, 3]}


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = content if isinstance(content, bytes) else (content if isinstance(content, str) else json.dumps(content)).encode()
    path.write_bytes(data)


def config(target, granularity, **more):
    return {"target_id": target, "granularity": granularity, "source_files": ["src/x.cpp"], "evaluation": {"expected_direct_tests": 2, "expected_full_tests": 5}, "model": {"num_ctx": 8192}, **more}


def stages(**failed):
    made = {s: {"status": "passed", "exit_code": 0, "elapsed_seconds": 1.5} for s in ("configure", "build", "direct_test", "full_test")}
    for stage, more in failed.items():
        later = list(made)[list(made).index(stage) + 1 :]
        made[stage] = {"passed": False, "exit_code": 2, "elapsed_seconds": 2.25, **more}
        made.update({s: {"skipped": True} for s in later})
    return made


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    here = tmp_path_factory.mktemp("invented")
    at = lambda target: here / "experiments" / f"{target}-roundtrip"
    for target, granularity, more in (("a-pass", "class_span", {"repository": "Own"}), ("a-build", "module_files", {}), ("b-broken", "class_span", {}), ("b-length", "class_span", {}), ("b-span", "class_span", {})):
        write(here / "configs" / "roundtrip" / "targets" / f"{target}.json", config(target, granularity, **more))
    write(here / "configs" / "roundtrip" / "targets" / "a-new.draft.json", {"enabled": False})

    write(at("a-pass") / "evaluation" / "evaluation_manifest.json", b"\xef\xbb\xbf" + json.dumps({"overall_pass": True, "stages": stages(), "restoration": {"restored": True, "repository_clean": True}}).encode())
    write(at("a-pass") / "backup" / "original_target.cpp", TREE)
    write(at("a-pass") / "generated" / "files" / "src" / "x.cpp", TREE + "// more\n")
    for kind in ("design_generation", "code_regeneration"):
        write(at("a-pass") / "raw_output" / f"{kind}_metadata.json", {"done_reason": "stop", "eval_count": 120 if kind.startswith("c") else 80, "prompt_eval_count": 7})

    write(at("a-build") / "evaluation" / "evaluation_manifest.json", {"overall_pass": "no", "stages": stages(build={"stderr_log": "build.log"})})
    # a log may hold any bytes: they are replaced
    write(at("a-build") / "build.log", b"[1/2] Building\n\xff note\nx.cpp:3:1: error:   expected ';'  before '}'\xfe\n")
    write(at("a-build") / "backup" / "files" / "src" / "x.cpp", b"int two;\n// \xe9\n")

    # a document may not: this one would tell a pass
    write(at("b-broken") / "evaluation" / "evaluation_manifest.json", b'{"overall_pass": true, "note": "\xff"}')
    write(at("b-broken") / "pipeline_failure.json", b'{"error": "\xff"}')
    write(here / "reports" / "batch" / "batch_execution.json", {"results": [{"target_id": "b-broken", "status": "failed", "reason": "given up"}]})
    write(here / "manifests" / "targets.csv", b"target_id,target_name\nb-broken,\xff\n")
    write(here / "manifests" / "runs.csv", "﻿run_id,target_id,status\nb-span-unknown-run,b-span,passed\n")

    write(at("b-length") / "evaluation" / "evaluation_manifest.json", {"overall_pass": False, "stages": {}})
    write(at("b-length") / "raw_output" / "design_generation_metadata.json", {"done_reason": "stop", "eval_count": 5})
    write(at("b-length") / "raw_output" / "code_regeneration_metadata.json", {"done_reason": "length", "eval_count": 900})
    write(at("b-span") / "notes.txt", "nothing was evaluated")
    return here


@pytest.fixture(scope="module")
def made(spark, root):
    write(root / "settings.json", SETTINGS)
    assert cli.main(["analyze", "--project-root", str(root), "--output-dir", str(root / "out"), "--study", str(root / "settings.json")], spark) == 0
    return root / "out"


def table(path):
    with open(path, encoding="utf-8", newline="") as file:
        return list(csv.DictReader(file))


def test_records(made):
    rows = {r["target_id"]: r for r in table(made / "main_results.csv")}
    assert list(rows) == ["a-build", "b-broken", "b-length", "b-span", "a-pass"] and list(rows["a-pass"]) == list(study.COLUMNS)
    told = lambda *names: {t: tuple(r[n] for n in names) for t, r in rows.items()}
    assert told("repository", "overall_pass", "result", "failure_stage", "failure_category") == {
        "a-build": ("Alpha", "False", "FAIL", "build", "syntax_error"),
        "b-broken": ("Beta", "False", "FAIL", "unknown", "unknown_failure"),
        "b-length": ("Beta", "False", "FAIL", "code_regeneration", "output_truncation"),
        "b-span": ("Beta", "True", "PASS", "", "none"),
        "a-pass": ("Own", "True", "PASS", "", "none"),
    }
    assert rows["a-build"]["failure_detail"] == "x.cpp:3:1: error: expected ';' before '}'�"
    assert rows["b-broken"]["failure_detail"] == "given up" and rows["b-broken"]["result_source"] == "batch/manifests fallback"
    assert told("original_loc", "original_chars", "original_measurement_scope", "generated_loc")["a-pass"] == ("3", "26", "class_span_backup", "4")
    assert told("original_loc", "original_chars", "original_measurement_scope")["a-build"] == ("2", "14", "module_files_backup")
    assert told("build_status", "build_exit_code", "direct_test_status", "total_recorded_elapsed_seconds")["a-build"] == ("failed", "2", "skipped", "3.75")
    assert "No evaluation_manifest.json was found" in rows["b-broken"]["data_quality_notes"]


def test_tables_and_summary(made):
    rates = {(r["dimension"], r["group"]): (r["total"], r["passed"], r["failed"]) for r in table(made / "group_statistics.csv")}
    assert rates["repository", "Beta"] == ("3", "1", "2") and rates["granularity", "class_span"] == ("4", "2", "2")
    funnel = {r["stage"]: (r["reached"], r["passed"], r["failed"], r["skipped"]) for r in table(made / "stage_funnel.csv")}
    assert funnel["build"] == ("2", "1", "1", "0") and funnel["direct_test"] == ("1", "1", "0", "1") and funnel["code_regeneration"][2] == "1"
    told = json.loads((made / "summary.json").read_text(encoding="utf-8"))
    assert (told["overall"]["total"], told["overall"]["passed"], told["overall"]["failed"]) == (5, 2, 3)
    assert told["failure_category_counts"] == {"output_truncation": 1, "syntax_error": 1, "unknown_failure": 1}
    assert told["generation"]["done_reason_length_count"] == 1 and told["normalization"]["records_with_metadata"] == 0
    test = told["inferential_analysis"]
    assert test["class_span_table"] == [2, 2] and test["module_files_table"] == [0, 1] and test["class_span_vs_module_files_fisher_two_sided_p"] == pytest.approx(1.0)
    code = told["quantitative_analysis"]["code_eval_count"]
    assert (code["n"], code["pass_mean"], code["fail_mean"], code["point_biserial_r"]) == (2, 120.0, 900.0, None)
    assert [r["target_id"] for r in table(made / "failure_analysis.csv")] == ["a-build", "b-broken", "b-length"]


def test_manifest_names_what_was_written(made, root):
    listed = json.loads((made / "analysis_manifest.json").read_text(encoding="utf-8"))
    assert listed["main_target_count"] == 5
    for file in listed["output_files"]:
        data = (root / file["path"]).read_bytes()
        assert (file["bytes"], file["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert (made / "summary.md").read_text(encoding="utf-8").startswith("# Summary")


def test_plan(spark, root, tmp_path):
    assert cli.main(["plan", "--project-root", str(root), "--output-dir", str(tmp_path)], spark) == 0
    assert {r["target_id"] for r in json.loads((tmp_path / "batch_plan.json").read_text(encoding="utf-8"))} == {"a-build", "a-pass", "b-broken", "b-length", "b-span"}


def test_strict_documents_must_be_text(spark, root, tmp_path):
    import shutil

    other = tmp_path / "study"
    shutil.copytree(root, other)
    write(other / "configs" / "roundtrip" / "targets" / "b-span.json", b'{"target_id": "b-span", "x": "\xff"}')
    assert cli.main(["analyze", "--project-root", str(other), "--output-dir", str(tmp_path / "o")], spark) != 0


def test_expectation_of_another_summary_fails(spark, root, tmp_path):
    write(tmp_path / "settings.json", SETTINGS | {"expected": [5, 3, 2]})
    assert cli.main(["analyze", "--project-root", str(root), "--output-dir", str(tmp_path / "o"), "--study", str(tmp_path / "settings.json")], spark) == 2

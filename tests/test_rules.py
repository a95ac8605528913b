"""Text rules, UDFs, sources, sinks and edge cases on small inputs."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from trialytics.functions import coerce, fmt, text
from trialytics.operators import catalog, groups, lookup, quant, records, registry, validate
from trialytics.schemas import EVALUATION, STAGES, stage_dimension
from trialytics.sinks import reports
from trialytics.sources import files
from trialytics.udf import cpp, fence, jsontext, mdtable

ENDS = ["", "a", "a\n", "a\n\n", "a\r\nb", "a\rb", "\x0b", "a\x0cb", "a\x1cb\x1e", "a\x85b", "a b ", "\n"]


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column.alias("v")).collect()]


def test_line_count(spark):
    assert values(spark, text.line_count("x"), ENDS) == [len(e.splitlines()) for e in ENDS]


def test_null_text(spark):
    for made in (text.line_count("x"), text.slug("x"), text.squash("x"), text.first_int("x"), text.markdown_cells("x"), coerce.coerce_bool("x"), coerce.coerce_int("x"), coerce.coerce_float("x"), coerce.normalize_status("x")):
        assert values(spark, made, [None]) in ([None], ["target"])


def test_coercion(spark):
    assert values(spark, coerce.coerce_int("x"), [" 7 ", "3.0", "1_000", "", "-4"]) == [7, None, 1000, None, -4]
    assert values(spark, coerce.coerce_bool("x"), ["Pass ", "ERROR", "2", "1.0"]) == [True, False, None, None]
    assert values(spark, coerce.coerce_bool("x"), [1.0, 0.0, 2.0, float("nan"), None], "x double") == [True, False, None, None, None]
    assert values(spark, coerce.coerce_bool("x"), [True, False], "x boolean") == [True, False] and values(spark, coerce.coerce_bool("x"), [1, 0, 7], "x int") == [True, False, None]
    assert values(spark, coerce.coerce_int("x"), [3.9, -3.9, float("nan"), float("inf")], "x double") == [3, -3, None, None]
    assert values(spark, coerce.coerce_int("x"), [True, False, None], "x boolean") == [1, 0, None]


def test_paths_and_names(spark):
    assert values(spark, text.source_paths("x"), ["see src/a/b.cpp, src/a/b.cpp and lib/x.h; y.cc"]) == [["src/a/b.cpp", "lib/x.h"]]
    assert values(spark, text.repeated_count("x"), ["CTest 12/13 then 13/13", "全63件", "CTest 1/2"]) == [13, 63, None]
    assert values(spark, text.bump_identifier("x"), ["run-001", "run-999", "run"]) == ["run-002", "run-1000", "run-002"]


def test_logs(spark):
    log = "[==========] 3 tests from 1 test suite ran.\n[  PASSED  ] 2 tests.\n[  FAILED  ] 1 test, listed below:"
    assert tuple(values(spark, text.gtest_counts("x"), [log])[0]) == (3, 2, 1)
    assert tuple(values(spark, text.ctest_counts("x"), ["100% tests passed, 0 tests failed out of 63"])[0]) == (63, 63, 0)
    assert values(spark, text.first_error_line("x", ["error:"]), ["note\na.cc:1:  error:  bad\r\nz"]) == ["a.cc:1: error: bad"]


def test_formats(spark):
    assert values(spark, fmt.duration("x"), [3.0, 61.5], "x double") == ["3.00秒", "1分1.50秒"]
    assert values(spark, fmt.percent("x"), [0.125, None], "x double") == ["12.5%", "—"]
    assert values(spark, fmt.markdown_cell("x"), ["a|b\nc", "", None]) == ["a\\|b c", "—", "—"]
    assert values(spark, text.fence_of("x"), ["a", "x ```` y"]) == ["```", "`````"]


def test_statistics_edges(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", 1.0, None), (None, 2.0, True), ("", None, True)], "g string, m double, ok boolean")
    got = {r.group: (r.total, r.passed, r.failed) for r in groups.pass_rates(rows, "g", F.col("ok")).collect()}
    assert got == {"a": (3, 1, 1), "unknown": (2, 2, 0)}
    assert quant.metrics_by_outcome(rows.where("g = 'a'"), ["m"], F.col("ok")).head().spearman is None
    empty = groups.overall(rows.where("false"), F.col("ok")).head()
    assert (empty.total, empty.pass_rate, empty.wilson_95_low) == (0, None, 0.0)
    assert quant.two_by_two(rows, F.col("g"), "a", "b", F.col("ok")).count() == 0


def test_braces():
    assert cpp.matching_brace('{ "}" /* } */ // }\n \'}\' {} }', 0) == 27
    assert cpp.matching_brace("{ {", 0) is None
    assert cpp.class_span("class A;\nclass A { };", "A")[2] == "2 declarations"
    assert cpp.class_span("x struct B { int a; }; y", "B")[:2] == (2, 22)
    assert cpp.without_bodies("int f() const { return 1; } void g() { if (a) { b(); } }") == "int f() const ; void g() ;"
    assert cpp.without_bodies("if (a) { b(); }") == "if (a) { b(); }"
    assert cpp.without_bodies("// f() { x\nint y;") is None  # a brace in a comment counts, and has no end
    assert cpp.without_bodies("struct A { int f() override { return 1; }\n};") == "struct A { int f() override ;\n};"


def test_fences(spark):
    mark = "```"
    made = lambda t, *a: values(spark, fence.normalize("x", *a), [t])[0]
    assert made("int a;")["strict_format_pass"] and made(None) is None
    kept = made(f"{mark}cpp\nint a;\r\nint b; \n{mark}")
    assert (kept["normalized"], kept["applied"], kept["language"], kept["strict_format_pass"]) == ("int a;\r\nint b; ", True, "cpp", False)
    assert kept["normalized_sha256"] == hashlib.sha256(b"int a;\r\nint b; ").hexdigest()
    errors = {f"{mark}cpp\nint a;": "unmatched_fence", f"{mark}java\n \n{mark}": "disallowed_language", f"{mark}\n{mark}\nx\n{mark}\n{mark}": "nested_fence", f"{mark}\n \n{mark}": "empty_body", f"x\n{mark}\ny\n{mark}": "unmatched_fence", f"{mark}json\nx\n{mark}": "disallowed_language"}
    assert {t: made(t)["error"] for t in errors} == errors
    assert made(f"{mark}json\n[]\n{mark}", fence.FILE_LANGUAGES)["normalized"] == "[]" and made(f"x {mark}cpp y")["error"] is None
    assert values(spark, text.strip_fence("x"), [f"{mark}cpp\nabc{mark}", f"{mark}cpp\n\nabc\n{mark}\n", f"{mark}a b\nabc\n{mark}"]) == [f"{mark}cpp\nabc{mark}", "abc", f"{mark}a b\nabc\n{mark}"]


def test_tables_agree(spark):
    doc = "| a | b |\n|---|:---:|\n| 1 | 2 |\n| 3 | 4 |\n| x |\n\n| c |\n| --- |\n| 5 |\n\n| --- |\n| --- |\n| 6 |\ntext\n| no |\n"
    want = [tuple(r) for r in mdtable.tables(doc)]
    rows = catalog.table_rows(spark.createDataFrame([("p", doc)], "path string, text string"), "path", "text").orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r.header, r.cells) for r in rows] == want and len(want) == 4


def test_recursive_entry():
    assert jsontext.find_entry({"a": [{"id": "x", "v": 1}]}, "x") == {"id": "x", "v": 1}
    assert jsontext.find_entry([], "x") is None
    assert jsontext.find_entry({"target_id": "a", "id": "b"}, "b") is None and jsontext.find_entry({"target_id": "", "id": "b"}, "b") == {"target_id": "", "id": "b"}
    assert jsontext.find_entry([{"n": {"id": "x", "v": 1}}, {"id": "x", "v": 2}], "x")["v"] == 1


def test_registry(spark):
    have = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 3, "z"), ("b", 4, "w"), ("c", 5, "q")], "k string, seq int, v string")
    assert sorted(map(tuple, registry.upsert(have, new, "k", "seq").collect())) == [("a", 1, "x"), ("b", 4, "w"), ("c", 5, "q")]
    assert sorted(r.k for r in registry.insert_if_absent(have, new.dropDuplicates(["k"]), "k").collect()) == ["a", "b", "c"]


def test_directories(spark):
    ids = spark.createDataFrame([("t1", "exp/custom"), ("t2", None), ("t3", None), ("t4", None)], "target_id string, configured string")
    dirs = spark.createDataFrame([("exp/custom",), ("exp/t2-roundtrip",), ("exp/t2-roundtrip-9",), ("exp/old-t3-b",), ("exp/old-t3-a",), ("exp/pilot-failures/t4-x",)], "path string")
    assert {r.target_id: r.path for r in lookup.resolve_directory(ids, dirs).collect()} == {"t1": "exp/custom", "t2": "exp/t2-roundtrip", "t3": "exp/old-t3-a"}


def test_records(spark):
    doc = json.dumps({"target_id": "t", "overall_pass": None, "stages": {"build": {"passed": True, "exit_code": 0, "elapsed_seconds": 1.5}, "full_test": {"passed": True, "counts": {"ran": 3, "passed": 3, "failed": 0}}}})
    evaluation = spark.createDataFrame([(doc,)], "j string").select(F.from_json("j", EVALUATION).alias("e")).select("e.*")
    stages = records.stages_of(evaluation, stage_dimension(spark))
    assert {r.stage: r.status for r in stages.collect()} == {**dict.fromkeys(STAGES, "not_recorded"), "build": "passed", "full_test": "passed"}


def test_record_rules(spark):
    names = {"overall_pass": True, "granularity": "class_span", "original_measurement_scope": "class_span_design_input_fallback", "retry_performed": None, "automatic_repair_performed": None, "code_done_reason": None, "design_done_reason": None, "generated_loc": 1, "legacy_format": False}
    names |= {f"{s}_status": "passed" for s in STAGES}
    cases = {"fine": {}, "scope": {"original_measurement_scope": "whole_source_files_fallback"}, "design failed": {"design_generation_status": "failed"},
        "stopped unpassed": {"code_done_reason": "stop", "code_regeneration_status": "unknown"}, "cut short": {"code_done_reason": "length"}, "unknown": {"overall_pass": None},
        "no size": {"code_done_reason": "stop", "generated_loc": None}}
    kind = {bool: "boolean", int: "int"}
    schema = "target_id string, " + ", ".join(f"{n} {kind.get(type(v), 'string')}" for n, v in (names | {"retry_performed": True, "automatic_repair_performed": True}).items())
    rows = spark.createDataFrame([(k, *(names | v).values()) for k, v in cases.items()], schema)
    found = {}
    for r in validate.violations(rows, "target_id", validate.record_rules()).collect():
        found.setdefault(r.target_id, []).append(r.rule_no)
    assert found == {"scope": [2], "design failed": [3], "stopped unpassed": [7], "cut short": [7], "unknown": [1], "no size": [5]}


def test_files_and_reports(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.json").write_text('﻿{"id": 1}', encoding="utf-8")
    (root / "b.json").write_text("[1]")
    (root / "c.draft.json").write_text("{}")
    docs = files.texts(spark, str(root))
    assert [r.path.rsplit("/", 1)[1] for r in files.json_objects(docs).orderBy("path").collect()] == ["a.json", "c.draft.json"]
    assert [r.path.rsplit("/", 1)[1] for r in files.configs(docs).collect()] == ["a.json", "b.json"]
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_objects_strict(docs).collect()
    df = spark.createDataFrame([("x|y", 1.0, None)], "a string, b double, c string")
    reports.write_csv(df, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == "a,b,c\nx|y,1.0,\n"
    assert reports.markdown_table(df).splitlines()[2] == "| x\\|y | 1.0 | — |"
    assert "&lt;" in reports.svg_bars("a<b", [("x", 1), ("y", 0)])
    assert reports.manifest([str(tmp_path / "o.csv")], str(tmp_path))[0]["bytes"] == os.path.getsize(tmp_path / "o.csv")
    assert reports.fenced("``` a").startswith("````")


def test_tables_of_lines_are_those_of_texts(spark):
    """Both table functions and the operator over the same documents: runs broken by width, text and document, tables without rows, separators at the start."""
    import random

    from trialytics.operators import catalog
    from trialytics.udf import mdtable

    rng = random.Random(6)
    parts = ["| a | b |", "| c | d |", "|---|---|", "|:-:|", "| one |", "text", "", "| x | y | z |", "|---|---|---|"]
    docs = {f"d{i}": "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for i in range(60)}
    frame = spark.createDataFrame(list(docs.items()), "path string, text string").repartition(4)
    lines = spark.createDataFrame([(p, i, x) for p, text in docs.items() for i, x in enumerate(text.split("\n"))], "path string, i int, line string").repartition(4)
    want = sorted((p, *row) for p, text in docs.items() for row in mdtable.tables(text))
    assert sorted(map(tuple, mdtable.tables_of_lines(lines, "path", "i", "line").collect())) == want
    assert sorted(map(tuple, catalog.table_rows(frame, "path", "text").collect())) == want


def test_error_lines_as_by_lines(spark):
    """Against looking at every line in turn; the words that a pattern begins with only spare texts that can't match."""
    import random
    import re

    from trialytics.operators.classify import ERROR_LINES

    assert text.literal_heads("ab cd|xyz:") == ["ab cd", "xyz:"] and text.literal_heads("Assert.*x|abcd?") == ["asser", "abc"] and text.literal_heads("ab|xyz") is None and text.literal_heads("a(b|c)def") is None
    rng = random.Random(3)
    parts = ["a.c:1: ERROR: x", "note", "", "  Fatal  error", "assertion `x' failed", "Assertion\tfailed", "timed out", "KILLED", "x\ty  Timeout", "tracebacK é", "failed\rx"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(200)] + [None]

    def by_hand(value):
        for pattern in ERROR_LINES if value is not None else ():
            for line in value.split("\n"):
                if re.search(pattern, line, re.IGNORECASE):
                    return re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ")
        return None

    assert values(spark, text.first_error_line("x", ERROR_LINES), texts) == [by_hand(t) for t in texts]

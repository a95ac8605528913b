"""The jobs over growing input: two runs take what is new, give what one run gives, and a repeated run changes nothing."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from conftest import DATA, ROOT
from oracle import connect, differences

from jobs import log_triage, trial_funnel
from trialytics.plans import job_queries  # noqa: F401  registers them
from trialytics.plans.queries import ORACLES, QUERIES

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", ["job1_log_triage", "job2_trial_funnel"])
def test_job_matches_sql(spark, name, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    done = QUERIES[name](spark, SMALL)
    assert differences(connect(SMALL), done, ORACLES[name], str(tmp_path / "out")) == ([], 0, 0)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


LOGS = [(1, "ok\n", "a"), (2, "x\nfoo.cpp:1: error: expected ';' before '}'\n", "a"), (3, None, None), (4, "", ""), (5, "/usr/bin/ld: undefined reference to `f'", "a/b=c")]
MORE = [(6, "FAILED: build timed out", "a"), (2, "fatal error: x.h: No such file or directory", "a"), (None, "killed\n", "b"), (None, "killed\n", "b")]
SCHEMA = "doc_id long, text string, source string"


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_triage_takes_only_new_logs(spark, tmp_path):
    logs, out, check = (str(tmp_path / n) for n in ("logs", "out", "check"))
    add(spark, LOGS, SCHEMA, logs)
    assert log_triage.run(spark, logs, out, check)["logs"] == 5
    assert log_triage.run(spark, logs, out, check) == {"batches": 0, "logs": 0}
    first = rows(spark.read.parquet(f"{out}/records"))
    add(spark, MORE, SCHEMA, logs)
    assert log_triage.run(spark, logs, out, check) == {"batches": 1, "logs": 4}
    kept = spark.read.schema(log_triage.record_schema(spark.read.parquet(logs).schema["doc_id"].dataType)).parquet(f"{out}/records")
    assert rows(spark.read.parquet(f"{out}/records").where("batch = 0")) == first and kept.count() == 9
    now = {r.id: r for r in log_triage.current(spark, out, kept.schema["id"].dataType).collect() if r.id is not None}
    assert {i: (r.repository, r.category) for i, r in now.items()} == {1: ("a", "none"), 2: ("a", "missing_definition_or_dependency"), 3: ("unknown", "none"), 4: ("unknown", "none"), 5: ("a/b=c", "missing_definition_or_dependency"), 6: ("a", "timeout_or_hang")}
    assert (now[1].lines, now[1].chars, now[1].error_line) == (1, 3, None) and now[2].batch == 1
    assert log_triage.current(spark, out, kept.schema["id"].dataType).where("id is null").count() == 2
    report = {r.repository: r for r in log_triage.report(spark, out).collect()}
    assert (report["a"].total, report["a"].passed, report["a"].failed) == (4, 1, 3) and report["unknown"].commonest_failure is None
    assert spark.read.option("header", True).csv(f"{out}/report").count() == 4


def test_triage_refuses_the_output_of_another_checkpoint(spark, tmp_path):
    """A lost checkpoint would count its logs a second time."""
    logs, out = str(tmp_path / "logs"), str(tmp_path / "out")
    add(spark, LOGS, SCHEMA, logs)
    log_triage.run(spark, logs, out, str(tmp_path / "check"))
    before = rows(spark.read.parquet(f"{out}/records")), rows(log_triage.report(spark, out))
    with pytest.raises(Exception, match="another checkpoint"):
        log_triage.run(spark, logs, out, str(tmp_path / "other"))
    assert (rows(spark.read.parquet(f"{out}/records")), rows(log_triage.report(spark, out))) == before
    add(spark, MORE, SCHEMA, logs)
    assert log_triage.run(spark, logs, out, str(tmp_path / "check"))["logs"] == 4


def test_triage_mends_a_batch_that_was_cut_short(spark, tmp_path, monkeypatch):
    """The output of a batch is written, the checkpoint isn't: the batch comes again under its number."""
    logs, out, check = (str(tmp_path / n) for n in ("logs", "out", "check"))
    add(spark, LOGS, SCHEMA, logs)
    add(spark, MORE, SCHEMA, logs)
    real = log_triage._into_partitions

    def broken(df, path, *by):
        if path.endswith("counts"):
            raise OSError("lost")
        real(df, path, *by)

    monkeypatch.setattr(log_triage, "_into_partitions", broken)
    with pytest.raises(Exception, match="lost"):
        log_triage.run(spark, logs, out, check, {"files_per_batch": 1})
    assert spark.read.parquet(f"{out}/records").count() in (4, 5)
    monkeypatch.setattr(log_triage, "_into_partitions", real)
    assert log_triage.run(spark, logs, out, check, {"files_per_batch": 1}) == {"batches": 2, "logs": 9}
    other = str(tmp_path / "other")
    log_triage.run(spark, logs, other, str(tmp_path / "other-check"))
    assert rows(spark.read.parquet(f"{out}/records").drop("batch")) == rows(spark.read.parquet(f"{other}/records").drop("batch"))
    assert rows(log_triage.report(spark, out)) == rows(log_triage.report(spark, other))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(spark, listed, path, kind="timestamp_ntz"):
    frame = spark.createDataFrame(listed, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["col"]).col("ts").cast(kind))
    frame.coalesce(1).write.mode("append").parquet(path)


DAY1 = [(1, "2024-01-01 00:00:01", 1, "view", 50.0), (2, "2024-01-01 00:00:02.5", 1, "click", 5.0), (3, "2024-01-01 00:00:02.5", 1, "cart", 50.0), (4, "2024-01-01 23:59:59.999999", None, "zoom", None), (5, None, 1, "view", 1.0), (6, "2024-01-01 10:00:00", 2, "view", 25.0)]
DAY2 = [(7, "2024-01-02 00:00:00", 1, "view", 33.0), (8, "2024-01-02 08:00:00", 1, "view", 50.0)]
LATE = [(9, "2024-01-01 12:00:00", 2, "error", 1.0), (10, "2024-01-02 09:00:00", 1, "purchase", 70.0)]
DAY9 = [(11, "2024-01-09 09:00:00", 1, "view", 70.0), (12, "2024-01-02 07:00:00", 3, "view", 1.0)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_funnel_takes_only_new_results(spark, tmp_path, kind):
    path, out, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))
    events(spark, DAY1, path, kind)
    assert trial_funnel.run(spark, path, out, mark) == {"new": 5, "read": 5, "days": 1}
    got = {r.stage: r for r in spark.read.schema(trial_funnel.FUNNEL).parquet(f"{out}/funnel").collect()}
    assert [(got[s].passed, got[s].failed, got[s].skipped, got[s].unknown, got[s].reached) for s in ("view", "click", "cart", "other")] == [(1, 0, 1, 0, 1), (0, 1, 0, 0, 1), (0, 0, 1, 0, 0), (1, 0, 0, 0, 1)]
    assert trial_funnel.run(spark, path, out, mark)["new"] == 0
    events(spark, DAY2, path, kind)
    events(spark, LATE, path, kind)
    assert trial_funnel.run(spark, path, out, mark) == {"new": 3, "read": 9, "days": 2}
    events(spark, DAY9, path, kind)
    # the result of day 1 isn't read again; that of day 2 comes within late_days
    assert trial_funnel.run(spark, path, out, mark) == {"new": 1, "read": 11, "days": 3}
    whole = str(tmp_path / "whole")
    trial_funnel.run(spark, path, whole, str(tmp_path / "whole-mark"))
    for name in ("funnel", "trials"):
        assert rows(spark.read.parquet(f"{out}/{name}")) == rows(spark.read.parquet(f"{whole}/{name}"))


def test_funnel_mends_a_run_that_lost_its_mark(spark, tmp_path):
    path, out = (str(tmp_path / n) for n in ("events", "out"))
    events(spark, DAY1 + DAY2, path)
    trial_funnel.run(spark, path, out, str(tmp_path / "mark1"))
    before = rows(spark.read.parquet(f"{out}/funnel"))
    trial_funnel.run(spark, path, out, str(tmp_path / "mark2"))
    assert rows(spark.read.parquet(f"{out}/funnel")) == before


def test_funnel_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, [], path)
    assert trial_funnel.run(spark, path, str(tmp_path / "out"), str(tmp_path / "mark")) == {"new": 0, "read": 0, "days": 0}


@pytest.mark.parametrize("job, source, table, extra", [("log_triage", "logs", "documents", "checkpoint"), ("trial_funnel", "events", "events", "mark")])
def test_command_line(tmp_path, job, source, table, extra):
    out = tmp_path / "out"
    command = [sys.executable, f"{ROOT}/jobs/{job}.py", "--config", f"{ROOT}/jobs/{job}.json", f"--{source}", f"{SMALL}/{table}.parquet", "--output", str(out), f"--{extra}", str(tmp_path / extra), "--master", "local[2]"]
    done = subprocess.run(command, capture_output=True, text=True, timeout=240, cwd=tmp_path, env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert job in done.stderr and json.load(open(f"{ROOT}/jobs/{job}.json", encoding="utf-8")) == {**(log_triage if job == "log_triage" else trial_funnel).DEFAULTS}
    assert {p.name for p in out.iterdir()} >= ({"records", "counts", "report"} if job == "log_triage" else {"funnel", "trials"})

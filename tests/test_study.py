"""The published outcome of the study: seventeen targets, from their metric values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trialytics.operators import groups, quant
from trialytics.schemas import METRICS

# Target, granularity, passed, original_loc, original_chars, generated_loc, direct tests, full tests, tokens.
ROWS = [
    ("echo-web-server-block-deque", "module_files", False, 261, 6432, 262, 4, 63, 1980),
    ("echo-web-server-buffer", "module_files", False, 421, 11165, 400, 6, 63, 3274),
    ("echo-web-server-config", "module_files", False, 622, 17920, 713, 10, 63, 6080),
    ("echo-web-server-heap-timer", "module_files", False, 500, 13906, 423, 8, 63, 3247),
    ("echo-web-server-http", "module_files", False, 1192, 33334, 854, 9, 63, 6477),
    ("echo-web-server-io", "module_files", False, 217, 5588, 222, 2, 63, 1683),
    ("echo-web-server-ip", "module_files", True, 198, 4291, 190, 5, 63, 1400),
    ("echo-web-server-log", "module_files", False, 1636, 44559, None, 9, 63, 8192),
    ("echo-web-server-thread-pool", "module_files", False, 175, 4277, 155, 1, 63, 1150),
    ("echo-web-server-util", "module_files", False, 466, 12758, 451, 9, 63, 3630),
    ("ini-cpp-ini-writer", "function", True, 15, 557, 18, 3, 27, None),
    ("ini-cpp-inireader", "class_span", False, 416, 14847, 387, 24, 27, 3285),
    ("riscv-simulator-instruction", "module_files", False, 183, 5490, 146, 7, 18, 1508),
    ("riscv-simulator-memory", "class_span", True, 47, 1304, 55, 4, 18, 362),
    ("riscv-simulator-parser", "class_span", True, 36, 1124, 57, 3, 18, 355),
    ("riscv-simulator-register", "class_span", True, 24, 487, 40, 2, 18, 169),
    ("riscv-simulator-registerfile", "class_span", True, 37, 1342, 38, 1, 18, 246),
]
# metric: n, pass mean, pass median, fail mean, fail median, point-biserial, Spearman
WANTED = {
    "original_loc": (17, 59.5, 36.5, 553.5455, 421.0, -0.5545200193, -0.7789043068),
    "original_chars": (17, 1517.5, 1214.0, 15479.6364, 12758.0, -0.5649833280, -0.8040302522),
    "generated_loc": (16, 66.3333, 47.5, 401.3, 393.5, -0.6752710866, -0.7841568471),
    "expected_direct_tests": (17, 3.0, 3.0, 8.0909, 8.0, -0.4580735590, -0.5428755349),
    "expected_full_tests": (17, 27.0, 18.0, 55.6364, 63.0, -0.6503075310, -0.6576957751),
    "code_eval_count": (16, 506.4, 355.0, 3682.3636, 3274.0, -0.6271857134, -0.7751487696),
}


@pytest.fixture(scope="module")
def study(spark):
    return spark.createDataFrame(ROWS, "target_id string, granularity string, overall_pass boolean, " + ", ".join(f"{m} int" for m in METRICS))


def test_overall(study):
    row = groups.overall(study, F.col("overall_pass")).head()
    assert (row.total, row.passed, row.failed) == (17, 6, 11)
    assert row.pass_rate == pytest.approx(0.35294117647058826, abs=1e-15)
    assert (row.wilson_95_low, row.wilson_95_high) == (pytest.approx(0.17309720397243744, abs=1e-12), pytest.approx(0.5869963651478132, abs=1e-12))


def test_groups(study):
    rows = {r.group: r for r in groups.pass_rates(study, "granularity", F.col("overall_pass")).collect()}
    assert {k: (r.passed, r.total) for k, r in rows.items()} == {"class_span": (4, 5), "function": (1, 1), "module_files": (1, 11)}
    assert rows["module_files"].wilson_95_high == pytest.approx(0.377358, abs=1e-6)


def test_metrics(study):
    rows = {r.metric: r for r in quant.metrics_by_outcome(study, METRICS, F.col("overall_pass")).collect()}
    for metric, (n, *values) in WANTED.items():
        row = rows[metric]
        assert row.n == n
        assert [row.pass_mean, row.pass_median, row.fail_mean, row.fail_median] == [pytest.approx(v, abs=5e-5) for v in values[:4]]
        assert [row.point_biserial, row.spearman] == [pytest.approx(v, abs=1e-9) for v in values[4:]]


def test_fisher(study):
    row = quant.two_by_two(study, F.col("granularity"), "class_span", "module_files", F.col("overall_pass")).head()
    assert (row.a, row.b, row.c, row.d) == (4, 1, 1, 10)
    assert row.fisher_p == pytest.approx(0.01282051282051282, abs=1e-12)

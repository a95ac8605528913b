"""Statistics on hard numbers: large means, large tables, ties, nulls and hot groups; plans that run nothing when they are made."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialytics.functions.stats import fisher_exact
from trialytics.operators import quant


def fisher_by_hand(a, b, c, d):
    row, column, total = a + b, a + c, a + b + c + d
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = lambda x: math.exp(log(column, x) + log(total - column, row - x) - log(total, row))
    return min(1.0, sum(p for x in range(max(0, row - (total - column)), min(row, column) + 1) if (p := chance(x)) <= chance(a) + 1e-12))


def fisher(spark, tables):
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")
    return [r[0] for r in frame.orderBy("i").select(fisher_exact("a", "b", "c", "d")).collect()]


def test_fisher_of_small_tables(spark):
    rng = random.Random(4)
    tables = [tuple(rng.randint(0, m) for _ in range(4)) for m in (2, 5, 12, 40, 300) for _ in range(25)]
    tables = [t for t in tables if sum(t)] + [(0, 0, 0, 7), (7, 0, 0, 0), (0, 9, 9, 0), (300, 1, 2, 500), (0, 3000, 5, 4)]
    for table, p in zip(tables, fisher(spark, tables), strict=True):
        assert p == pytest.approx(fisher_by_hand(*table), rel=1e-8, abs=1e-15), table


def test_fisher_golden_and_large(spark):
    assert fisher(spark, [(11, 0, 1, 1)]) == [pytest.approx(fisher_by_hand(11, 0, 1, 1), rel=1e-15)]
    assert fisher(spark, [(11, 0, 0, 2)])[0] == pytest.approx(1 / 78, rel=1e-15)
    fisher(spark, [(3, 4, 5, 6)])
    began = time.time()
    got = fisher(spark, [(250_300, 249_700, 249_500, 250_500)])[0]
    assert time.time() - began < 2 and got == pytest.approx(fisher_by_hand(250_300, 249_700, 249_500, 250_500), rel=1e-6)
    assert 0 <= fisher(spark, [(4_000_000_000, 10, 10, 4_000_000_000)])[0] < 1e-8  # of so many tables, those below the tolerance sum to this
    assert fisher(spark, [(None, 1, 1, 1)]) == [None]


def test_point_biserial_at_a_large_mean(spark):
    values = [1e9 + i / 4 for i in range(12)]
    passed = [i % 3 == 1 or i > 8 for i in range(12)]
    frame = spark.createDataFrame(list(zip(values, passed, strict=True)), "x double, ok boolean")
    row = quant.metrics_by_outcome(frame, ["x"], F.col("ok")).head()
    want = np.corrcoef(np.array(values) - 1e9, np.array(passed, dtype=float))[0, 1]
    assert row.point_biserial == pytest.approx(want, abs=1e-9)
    assert row.pass_median == pytest.approx(np.median([v for v, p in zip(values, passed, strict=True) if p]))


def ranks_by_hand(rows):
    """Mean ranks of (group, value) rows, nulls first."""
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    out = []
    key = lambda v: (v is not None, v if v is not None else 0)
    for g, v in rows:
        lower = sum(key(x) < key(v) for x in groups[g])
        same = sum(x == v for x in groups[g])
        out.append((g, v, lower + (same + 1) / 2))
    return sorted(out, key=repr)


def test_ranks_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, *range(40), *(rng.random() * 1e6 for _ in range(40))])) for _ in range(900)]
    frame = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(5)
    got = sorted(((r.g, r.v, r.avg_rank) for r in quant.average_rank(frame, "v", "g").collect()), key=repr)
    assert got == ranks_by_hand([(g, None if v is None else float(v)) for g, v in rows])


def test_ranks_of_words_and_of_no_groups(spark):
    rng = random.Random(3)
    words = [("", "".join(rng.choice("abé") for _ in range(rng.randint(0, 4)))) for _ in range(3000)]
    frame = spark.createDataFrame([(w,) for _, w in words], "w string").repartition(3)
    got = sorted((("", r.w, r.avg_rank) for r in quant.average_rank(frame, "w").collect()), key=repr)
    assert got == ranks_by_hand(words)
    assert quant.average_rank(frame.where("false"), "w").count() == 0


def test_spearman_of_large_ranks(spark):
    rng = random.Random(5)
    pairs = [(float(rng.randint(0, 50)), rng.random()) for _ in range(2000)]
    frame = spark.createDataFrame(pairs, "x double, y double")
    got = quant.spearman(frame, "x", "y").head()
    want = np.corrcoef(_ranks([p[0] for p in pairs]), _ranks([p[1] for p in pairs]))[0, 1]
    assert got.n == 2000 and got.spearman == pytest.approx(want, abs=1e-12)
    assert quant.spearman(frame.limit(2), "x", "y").head().spearman is None
    assert quant.spearman(frame.withColumn("x", F.lit(1.0)), "x", "y").head().spearman is None


def _ranks(values):
    order = np.argsort(values, kind="stable")
    sorted_values = np.array(values)[order]
    first, last = np.searchsorted(sorted_values, values, "left"), np.searchsorted(sorted_values, values, "right")
    return (first + last + 1) / 2


def test_plans_run_no_jobs(spark):
    frame = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"), (F.col("id") % 2 == 0).alias("ok"))
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        made = [quant.average_rank(frame, "v", "g"), quant.spearman(frame, "v", "g"), quant.metrics_by_outcome(frame, ["v"], F.col("ok"))]
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("lazy") == []
        assert [m.count() for m in made] == [100, 1, 1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

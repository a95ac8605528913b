"""Containment of keys, against comparing every pair."""

from __future__ import annotations

import random

import pytest

from trialytics.operators import lookup


@pytest.mark.parametrize("most", [3, 200_000])
def test_containing_finds_all_pairs(spark, monkeypatch, most):
    """Keys that share their beginnings, hold each other, repeat, are empty or null; in one automaton and in many."""
    monkeypatch.setattr(lookup, "AUTOMATON_KEYS", most)
    monkeypatch.setattr(lookup, "CELL_KEYS", 7 if most == 3 else 1_000_000)
    rng = random.Random(8)
    small = [f"echo-web-{''.join(rng.choice('ab') for _ in range(rng.randint(0, 3)))}" for _ in range(30)] + ["a", "é", "", None, "echo", "echo"]
    large = [f"x{rng.choice(small[:30])}{rng.choice(['', 'é', '-echo-web-'])}" for _ in range(60)] + ["", None, "aa", "echo", "zz"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string").repartition(3)
    got = sorted(map(tuple, lookup.containing(frame(small), frame(large)).collect()))
    want = sorted({(s, x) for s in small for x in large if s is not None and x is not None and s in x and (s or not x)})
    assert got == want
    assert lookup.containing(frame(small).limit(0), frame(large)).count() == 0 and lookup.containing(frame(small), frame(large).limit(0)).count() == 0


def test_directories_by_containment(spark):
    ids = spark.createDataFrame([("echo-log", None), ("echo", "own/place"), ("none", None), ("web", None)], "target_id string, configured string")
    dirs = spark.createDataFrame([("r/b-echo-log-2",), ("r/a-echo-log",), ("r/pilot-failures/echo-log-0",), ("r/place",), ("r/web-roundtrip",), ("r/a-web",)], "path string")
    got = {r.target_id: r.path for r in lookup.resolve_directory(ids, dirs).collect()}
    assert got == {"echo-log": "r/a-echo-log", "echo": "r/place", "web": "r/web-roundtrip"}

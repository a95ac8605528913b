"""Every query against its SQL at the smallest scale."""

from __future__ import annotations

import json
import re

import pytest
from conftest import DATA
from oracle import connect, differences

from trialytics.plans import rule_queries  # noqa: F401  registers its queries
from trialytics.plans.queries import ORACLES, QUERIES

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name, tmp_path):
    assert differences(con, QUERIES[name](spark, FOLDER), ORACLES[name], str(tmp_path / "out")) == ([], 0, 0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_similarity_pairs_compares_all_neighbours(spark, tmp_path):
    """Long texts and rows without n_chars are compared too, as the standard library compares them."""
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé,.") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (900, 20, 700, 30, 800)]
    texts += [texts[-1], texts[-1].replace("a", "b", 40), texts[-1].replace(" ", "\n"), "abc", "", None, "x", texts[0][:4000]]
    rows = [(i, "en", t, None if i % 3 == 1 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, (x, y) in enumerate(zip(texts, texts[1:], strict=False)):
        bare = [None if v is None else re.sub(r"\s+", "", v) for v in (x, y)]
        want.append((i, None, None, None) if x is None or y is None else (i, x == y, bare[0] == bare[1], SequenceMatcher(None, x, y).ratio()))
    assert sorted(map(tuple, QUERIES["similarity_pairs"](spark, str(tmp_path)).collect())) == want


def test_similarity_of_many_pairs_takes_few_calls(monkeypatch):
    """Pairs are matched together, with the standard library's ratios; the calls a pair don't grow with its matching blocks."""
    import random
    import sys
    from difflib import SequenceMatcher

    import pandas as pd

    from trialytics.udf import similarity

    rng = random.Random(9)
    left, right = [], []
    for _ in range(300):
        letters = rng.choice(("abcdefgh", "aé日😀b ", "abcdefghijklmnopqrstuvwxyz .,"))
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 60, 199, 200, 199, 150, 700)))) for _ in range(2))
        at = rng.randint(0, len(a))
        left.append(a)
        right.append(rng.choice((b, b, a[at:] + b[:30] + a[:at], a[:at] + b + a[at:], a)))
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = similarity.similarity.func(pd.Series(left), pd.Series(right))
    finally:
        sys.setprofile(None)
    assert got.tolist() == want and calls < 180 * len(left)  # 131; 241 pair by pair
    for together in (0, 2000):  # each alone, a few at once
        monkeypatch.setattr(similarity, "TOGETHER", together)
        assert similarity.ratios([None, *left, "x"], ["x", *right, None]) == [None, *want, None]


def rows_of(spark, name, key):
    return {r[key]: r for r in QUERIES[name](spark, FOLDER).collect()}


def plain_closing(text, opening):
    """Place of the matching brace, letter by letter."""
    depth, state, at = 0, "", opening
    while at < len(text):
        two, one = text[at : at + 2], text[at]
        if state == "":
            if two in ("//", "/*"):
                state, at = two, at + 1
            elif one in "\"'":
                state = one
            else:
                depth += (one == "{") - (one == "}")
                if one == "}" and depth == 0:
                    return at
        elif state == "//":
            state = "" if one == "\n" else state
        elif state == "/*":
            if two == "*/":
                state, at = "", at + 1
        elif one == "\\":
            at += 1
        elif one == state:
            state = ""
        at += 1
    return None


def test_brace_match(spark, con):
    got = rows_of(spark, "brace_match", "page_id")
    for page, html in con.sql("SELECT page_id, html FROM pages").fetchall():
        at = html.find("{")
        assert got[page].opening == at and got[page].closing == (plain_closing(html, at) if at >= 0 else None)


def test_strip_bodies(spark, con):
    import hashlib

    got = rows_of(spark, "strip_bodies", "page_id")
    for page, html in con.sql("SELECT page_id, html FROM pages").fetchall():
        text, out, done, at = "int f() const { return 1; } if (x) { y(); }\n" + html, "", 0, 0
        while out is not None and (at := text.find("{", at)) >= 0:
            head = text[max(0, at - 240) : at].rstrip()
            called = re.search(r"\)\s*(const\s*)?(noexcept\s*)?(override\s*)?(final\s*)?$", head) and not re.search(r"\b(if|for|while|switch|catch)\s*\([^)]*\)\s*$", head)
            end = plain_closing(text, at) if called else at
            if called:
                out = None if end is None else out + text[done:at] + ";"
                done = 0 if end is None else end + 1
            at = (end or at) + 1
        want = None if out is None else hashlib.sha256((out + text[done:]).encode()).hexdigest()
        assert got[page].digest == want


def test_class_spans(spark, con):
    got = rows_of(spark, "class_spans", "p_partkey")
    for key, name in con.sql("SELECT p_partkey, p_name FROM part").fetchall():
        source = "struct P { int a; };\nclass X : P { void f() { if (a) { a = '}'; } } };\n" + name
        start = source.index("class X") if key % 2 == 0 else None
        end = None if start is None else source.index(";", plain_closing(source, source.index("{", start))) + 1
        assert (got[key].start, got[key].end, got[key].error) == (start, end, None if key % 2 == 0 else "0 declarations")


def test_source_paths(spark, con):
    got = rows_of(spark, "source_paths", "page_id")
    letter = "[A-Za-z0-9_.-]"
    for page, url, html in con.sql("SELECT page_id, url, html FROM pages").fetchall():
        found = re.findall(rf"(?<!{letter})({letter}+(?:/{letter}+)+\.(?:cpp|cxx|hpp|hxx|cc|hh|c|h))(?!{letter})", url + " src/a/b.cpp, include/x.hpp " + html)
        assert got[page].paths == list(dict.fromkeys(found)) and len(found) >= 2


def test_backref_counts(spark, con):
    got = rows_of(spark, "backref_counts", "o_orderkey")
    for (key,) in con.sql("SELECT o_orderkey FROM orders").fetchall():
        found = re.search(r"CTest[^\n]*?(\d+)\s*/\s*\1", f"CTest {key % 60}/63, then {key % 60}/{key % 60}")
        assert got[key].n == int(found[1])


def test_json_errors(spark, con):
    got = rows_of(spark, "json_errors", "event_id")
    for key, props in con.sql("SELECT event_id, props FROM events").fetchall():
        text = props if key % 2 == 0 else props[:6]
        try:
            json.loads(text)
            want = (None, None, None)
        except json.JSONDecodeError as e:
            want = (e.lineno, e.colno, e.msg)
        assert (got[key].line, got[key].column, got[key].message) == want

"""Text rules over columns: counts, slugs, logs, Markdown rows, paths."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialytics.functions.coerce import _c

# Line ends of universal newlines, and source suffixes, longest first.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]"
SOURCE_SUFFIXES = ("cpp", "cxx", "hpp", "hxx", "cc", "hh", "c", "h")


def line_count(x: Column | str) -> Column:
    """Lines by universal newlines; an ending newline starts no line."""
    text = _c(x)
    ends = F.regexp_count(text, F.lit(LINE_END))
    return (ends + F.when((F.length(text) > 0) & ~text.rlike(f"(?s)({LINE_END})\\z"), 1).otherwise(0)).cast("bigint")


def slug(x: Column | str) -> Column:
    text = F.replace(F.lower(F.trim(_c(x))), F.lit("::"), F.lit("-"))
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("target"))


def squash(x: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def first_int(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"\d+", 0), F.lit("")).try_cast("bigint")


def strip_marks(x: Column | str) -> Column:
    """Without surrounding backticks, then asterisks, then blanks."""
    return F.trim(F.btrim(F.btrim(F.trim(_c(x)), F.lit("`")), F.lit("*")))


def source_paths(x: Column | str) -> Column:
    """Distinct relative source paths, in order."""
    letter = "[A-Za-z0-9_.-]"  # fixed values: what such a path looks like
    pattern = rf"(?<!{letter}){letter}+(?:/{letter}+)+\.(?:{'|'.join(SOURCE_SUFFIXES)})(?!{letter})"
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(0)))


# Ways to write a full test count, in order.
FULL_COUNTS = (r"全GoogleTest[^\n]*?(\d+)\s*/\s*\1", r"CTest[^\n]*?(\d+)\s*/\s*\1", r"全(\d+)件")


def repeated_count(x: Column | str, patterns: Sequence[str] = FULL_COUNTS) -> Column:
    """The count by the first pattern that matches; a back-reference asks for the same number twice."""
    found = (F.nullif(F.regexp_extract(_c(x), "(?iu)" + p, 1), F.lit("")) for p in patterns)
    return F.coalesce(*found).try_cast("bigint")


def last_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(group)), F.lit(-1))


# Fixed values below: what test tools print.
def gtest_counts(x: Column | str) -> Column:
    """struct(ran, passed, failed) by the last summary lines; failed is 0 where nothing failed."""
    number = lambda p: last_match(x, p).try_cast("bigint")
    return F.struct(number(r"\[==========\]\s+(\d+)\s+tests?\s+from").alias("ran"), number(r"\[\s*PASSED\s*\]\s+(\d+)\s+tests?").alias("passed"), F.coalesce(number(r"\[\s*FAILED\s*\]\s+(\d+)\s+tests?"), F.lit(0).cast("bigint")).alias("failed"))


def ctest_counts(x: Column | str) -> Column:
    """struct(ran, passed, failed) of 'P% tests passed, F tests failed out of T'."""
    pattern = r"\d+%\s+tests\s+passed,\s+(\d+)\s+tests\s+failed\s+out\s+of\s+(\d+)"
    failed, ran = (F.nullif(F.regexp_extract(_c(x), pattern, g), F.lit("")).try_cast("bigint") for g in (1, 2))
    return F.struct(ran.alias("ran"), (ran - failed).alias("passed"), failed.alias("failed"))


def literal_heads(pattern: str) -> list[str] | None:
    """What the alternatives of a pattern begin with, in lower case; None if one has no plain beginning of three characters."""
    heads = [re.match(r"[A-Za-z0-9 :_-]*", part)[0] for part in pattern.split("|")]
    # a last character may be repeated or left out by what follows it
    cut = [h if len(h) == len(part) else h[:-1] for h, part in zip(heads, pattern.split("|"), strict=True)]
    return [h.lower() for h in cut] if "(" not in pattern and "[" not in pattern and "\\" not in pattern and all(len(h) >= 3 for h in cut) else None


def first_error_line(x: Column | str, patterns: Sequence[str], size: int = 500) -> Column:
    """The first line that matches the first pattern that matches at all; blanks collapsed, cut to size.

    Patterns match within lines ('.' matches no line end). Each is looked for once, from the
    text's start, and only in texts that hold one of the words it begins with; the line is cut
    out around the place where it is found.
    """
    text = _c(x)

    def line(pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(f"(?id)(?:{pattern})"))
        if heads := literal_heads(pattern):
            at = F.when(reduce(Column.__or__, (F.lower(text).contains(h) for h in heads)), at)
        around = F.concat(F.substring_index(F.left(text, at - 1), "\n", -1), F.substring_index(F.substring(text, at, F.length(text)), "\n", 1))
        return F.when(at > 0, around)

    return F.left(F.trim(F.regexp_replace(F.coalesce(*map(line, patterns)), r"\s+", " ")), F.lit(size))


def strip_fence(x: Column | str) -> Column:
    """The body of one outer code fence, whose closing fence has a line of its own, else the text."""
    pattern = r"(?s)\A\s*```[A-Za-z0-9_+.-]*\s*\n(.*)\n```\s*\z"  # fixed value: what such a text looks like
    return F.when(_c(x).rlike(pattern), F.regexp_extract(_c(x), pattern, 1)).otherwise(_c(x))


def bump_identifier(x: Column | str) -> Column:
    """The number at the end plus one, three digits at least; '-002' where there is none."""
    number = F.regexp_extract(_c(x), r"^(.*)-(\d{3,})$", 2)
    stem = F.regexp_extract(_c(x), r"^(.*)-(\d{3,})$", 1)
    return F.when(number != "", F.format_string("%s-%03d", stem, number.try_cast("bigint") + 1)).otherwise(F.concat(_c(x), F.lit("-002")))


def unify_newlines(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "\\r\\n?", "\n")


def normalized_text(x: Column | str) -> Column:
    return F.regexp_replace(unify_newlines(x), r"\A\s+|\s+\z", "")


def include_lines(x: Column | str) -> Column:
    kept = F.filter(F.split(unify_newlines(x), "\n"), lambda s: s.rlike(r"^\s*#include"))
    return F.transform(kept, lambda s: F.regexp_replace(s, r"\s+\z", ""))


def indent(x: Column | str, blank: str) -> Column:
    """Each line that isn't blank, indented."""
    return F.array_join(F.transform(F.split(_c(x), "\n"), lambda s: F.when(F.trim(s) == "", s).otherwise(F.concat(F.lit(blank), s))), "\n")


def renewline(x: Column | str, newline: str) -> Column:
    return F.replace(unify_newlines(x), F.lit("\n"), F.lit(newline))


def by_substring(x: Column | str, rules: Sequence[tuple[str, str]], default: str = "") -> Column:
    """The value of the first rule whose part the text contains."""
    out = F.lit(default)
    for part, value in reversed(rules):
        out = F.when(F.lower(_c(x)).contains(part.lower()), value).otherwise(out)
    return out


def find_column(headers: Column | str, keywords: Sequence[str]) -> Column:
    """Place (from 1) of the first header that contains the first keyword that any contains; 0: none."""
    def place(keyword: str) -> Column:
        return F.array_position(F.transform(_c(headers), lambda h: F.lower(h).contains(keyword.lower())), True)

    places = [place(k) for k in keywords]
    return F.coalesce(*(F.when(p > 0, p) for p in places), F.lit(0).cast("bigint"))


def markdown_cells(x: Column | str) -> Column:
    """Trimmed cells of a table row; null for any other line."""
    line = F.trim(_c(x))
    cells = F.split(F.btrim(line, F.lit("|")), "\\|")
    return F.when(line.startswith("|"), F.transform(cells, lambda s: F.trim(s)))


def is_separator(cells: Column | str) -> Column:
    return (F.size(_c(cells)) > 0) & F.forall(_c(cells), lambda c: c.rlike(r"^:?-{3,}:?$"))


def bullets(x: Column | str) -> Column:
    """array of struct(name, status) of '- **name — status**' lines."""
    pattern = r"(?md)^\s*-\s+\*\*(.+?)\s+[—-]\s+([^*]+)\*\*"  # fixed value
    names, states = (F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(names.alias("name"), states.alias("status")), lambda p: F.struct(strip_marks(p["name"]).alias("name"), F.trim(p["status"]).alias("status")))


def judgments(x: Column | str) -> Column:
    """array of struct(name, status, notes) of table rows that judge a target."""
    pattern = r"(?md)^\|\s*([A-Za-z][A-Za-z0-9_-]*)\s*\|\s*(条件付き採用|採用|除外)\s*\|\s*(.*?)\s*\|$"  # fixed value
    names, states, notes = (F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(g)) for g in (1, 2, 3))
    return F.arrays_zip(names.alias("name"), states.alias("status"), notes.alias("notes"))


def overall_from_markdown(x: Column | str) -> Column:
    """True where the text tells an overall pass, false where it tells only an overall failure."""
    told = lambda word: _c(x).rlike(rf"(?i)\boverall\s*(?:result|status)?\s*[:|]\s*{word}\b")  # noqa: E731  fixed value
    return F.when(told("pass"), True).when(told("fail"), False)


def called_methods(x: Column | str, variable: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(rf"\b{variable}\.(\w+)\("), F.lit(1))))


def line_of_offset(x: Column | str, offset: Column) -> Column:
    """Line (from 1) of a place (from 0)."""
    before = F.left(_c(x), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("bigint") + 1


def fill(x: Column | str, values: dict[str, Column]) -> Column:
    """{{NAME}} replaced by each value."""
    out = _c(x)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def fence_of(x: Column | str) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(_c(x), F.lit("`+"), F.lit(0)), lambda s: F.length(s))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def class_declarations(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"\b(?:class|struct)\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^;{]*)?\{"), F.lit(1))


def test_declarations(x: Column | str) -> Column:
    """array of struct(suite, test) of TEST, TEST_F and TEST_P."""
    pattern = r"\bTEST(?:_F|_P)?\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)"
    suites, tests = (F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.arrays_zip(suites.alias("suite"), tests.alias("test"))


def locate_section(x: Column | str, opening: str, closing: str = r"(?m)^};") -> Column:
    """struct(start, end), places from 1, from the only occurrence of opening through the next closing; nulls otherwise."""
    start = F.when(F.size(F.split(_c(x), opening.replace("(", r"\(").replace("{", r"\{"))) == 2, F.instr(_c(x), opening))
    rest = F.substring(_c(x), start, F.length(_c(x)))
    match = F.regexp_substr(rest, F.lit(closing))
    at = F.when(match.isNotNull(), F.regexp_instr(rest, F.lit(closing)))
    return F.struct(start.cast("bigint").alias("start"), (start + at + F.length(match) - 2).cast("bigint").alias("end"))

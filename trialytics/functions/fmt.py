"""Formatting, ratios and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialytics.functions.coerce import _c

ABSENT = "—"


def plain_number(x: Column | str, digits: int) -> Column:
    """Half-even decimal text without grouping."""
    return F.replace(F.format_number(_c(x), digits), F.lit(","), F.lit(""))


def percent(x: Column | str, digits: int = 1, absent: str = ABSENT) -> Column:
    return F.coalesce(F.concat(plain_number(_c(x) * 100.0, digits), F.lit("%")), F.lit(absent))


def number(x: Column | str, digits: int = 3, absent: str = ABSENT) -> Column:
    return F.coalesce(plain_number(x, digits), F.lit(absent))


def duration(x: Column | str) -> Column:
    """Seconds, with minutes from 60 on."""
    seconds = _c(x)
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(plain_number(seconds, 2), F.lit("秒"))).otherwise(F.concat(minutes.cast("string"), F.lit("分"), plain_number(seconds - minutes * 60, 2), F.lit("秒")))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is null or 0."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def sha256(x: Column | str) -> Column:
    return F.sha2(_c(x), 256)


def hash_check(x: Column | str, expected: Column) -> Column:
    """exact, crlf_to_lf_normalized or mismatch."""
    return F.when(sha256(x) == expected, "exact").when(sha256(F.replace(_c(x), F.lit("\r\n"), F.lit("\n"))) == expected, "crlf_to_lf_normalized").otherwise("mismatch")


def markdown_cell(x: Column | str, newline: str = " ") -> Column:
    text = F.nullif(_c(x).cast("string"), F.lit(""))
    return F.coalesce(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\\r?\\n", newline), F.lit(ABSENT))


def xml_escape(x: Column | str) -> Column:
    out = _c(x)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out

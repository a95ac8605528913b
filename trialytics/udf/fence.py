"""Strict handling of one outer code fence, with what was done and why not. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages that a fence may name, for replies in code and replies in files; what an outer and a bare fence look like.
CODE_LANGUAGES = ("", "cpp", "c++", "cc", "cxx")
FILE_LANGUAGES = ("", "json")
OUTER = r"(?s)\A\s*```([A-Za-z0-9_+\-]*)[ \t]*\r?\n(.*)\r?\n```[ \t]*\s*\z"
BARE = r"(?md)^[ \t]*```[A-Za-z0-9_+\-]*[ \t]*$"


def normalize(raw: Column | str, languages: tuple[str, ...] = CODE_LANGUAGES) -> Column:
    """struct(normalized, error, applied, type, language, strict_format_pass, raw_sha256, normalized_sha256).

    The body of the only outer fence, verbatim, or the text if it has none. Errors, in this
    order: unmatched_fence, disallowed_language, empty_body, nested_fence; then normalized is
    null. A null text gives nulls.
    """
    x = F.col(raw) if isinstance(raw, str) else raw
    outer, bare = x.rlike(OUTER), lambda t: t.rlike(BARE)
    language, body = F.lower(F.regexp_extract(x, OUTER, 1)), F.regexp_extract(x, OUTER, 2)
    error = (
        F.when(~outer & bare(x), "unmatched_fence")
        .when(outer & ~language.isin(*languages), "disallowed_language")
        .when(outer & ~body.rlike(r"\S"), "empty_body")
        .when(outer & bare(body), "nested_fence")
    )
    normalized = F.when(error.isNull(), F.when(outer, body).otherwise(x))
    applied = outer & error.isNull()
    digest = lambda t: F.sha2(t.cast("binary"), 256)
    made = F.struct(
        normalized.alias("normalized"), error.alias("error"), applied.alias("applied"), F.when(applied, "outer_markdown_fence").otherwise("none").alias("type"), F.when(applied, language).alias("language"),
        (~applied & error.isNull()).alias("strict_format_pass"), digest(x).alias("raw_sha256"), digest(normalized).alias("normalized_sha256"),
    )
    return F.when(x.isNotNull(), made)

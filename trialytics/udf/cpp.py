"""C++ text: matching braces, class spans, interfaces without bodies. Arrow-batched UDFs around one tokenising pattern."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What hides braces: comments, strings and characters; then braces themselves.
LEXEME = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|[{}]""", re.S)
# What stands before a function's body, and before a control statement's; how far back is looked.
CALLABLE = re.compile(r"\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:final\s*)?\Z")
CONTROL = re.compile(r"\b(?:if|for|while|switch|catch)\s*\([^)]*\)\s*\Z")
LOOK_BACK = 240
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("error", T.StringType())])


def matching_brace(text: str, opening: int) -> int | None:
    """Place of the brace that closes the one at `opening`; None if there is none."""
    depth = 0
    for token in LEXEME.finditer(text, opening):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if token[0] == "}" and depth == 0:
            return token.start()
    return None


def class_span(text: str, symbol: str) -> tuple[int | None, int | None, str | None]:
    """(start, end, error) of the only class or struct of that name, with the semicolon behind it if one follows."""
    found = list(re.finditer(rf"\b(?:class|struct)\s+{re.escape(symbol)}\b", text))
    if len(found) != 1:
        return None, None, f"{len(found)} declarations"
    opening = text.find("{", found[0].end())
    closing = matching_brace(text, opening) if opening >= 0 else None
    if closing is None:
        return None, None, "no body"
    semicolon = text.find(";", closing)
    return found[0].start(), (semicolon if semicolon >= 0 else closing) + 1, None


def without_bodies(text: str) -> str | None:
    """The text with function bodies replaced by semicolons; None if a body has no end.

    A lexical rule: any opening brace counts, in comments and strings too, behind whose
    look-back a parameter list ends that isn't a control statement's. What stands before the
    brace stays as it is, blanks included.
    """
    out, done = [], 0
    for brace in re.finditer("{", text):
        at = brace.start()
        if at < done:
            continue
        head = text[max(0, at - LOOK_BACK) : at].rstrip()
        if CALLABLE.search(head) and not CONTROL.search(head):
            if (closing := matching_brace(text, at)) is None:
                return None
            out += [text[done:at], ";"]
            done = closing + 1
    return "".join(out) + text[done:]


@F.pandas_udf(T.IntegerType())
def matching_brace_udf(text: pd.Series, opening: pd.Series) -> pd.Series:
    """Places from 0; null for a null, and where no brace matches."""
    return pd.Series([None if t is None or pd.isna(o) or not 0 <= o < len(t) or t[int(o)] != "{" else matching_brace(t, int(o)) for t, o in zip(text, opening, strict=True)], dtype="Int32")


@F.pandas_udf(SPAN)
def class_span_udf(text: pd.Series, symbol: pd.Series) -> pd.DataFrame:
    rows = [(None, None, "null") if t is None or s is None else class_span(t, s) for t, s in zip(text, symbol, strict=True)]
    return pd.DataFrame({"start": pd.array([r[0] for r in rows], dtype="Int32"), "end": pd.array([r[1] for r in rows], dtype="Int32"), "error": [r[2] for r in rows]})


@F.pandas_udf(T.StringType())
def without_bodies_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else without_bodies(t))

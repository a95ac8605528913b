"""JSON texts: error context, pretty printing, recursive search."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("message", T.StringType())])


@F.pandas_udf(CONTEXT)
def error_context(text: pd.Series) -> pd.DataFrame:
    """Where a text stops being JSON, with 80 characters to both sides; nulls for valid and null texts."""
    rows = []
    for t in text:
        try:
            json.loads(t) if t is not None else None
            rows.append((None, None, None, None))
        except json.JSONDecodeError as e:
            rows.append((e.lineno, e.colno, t[max(0, e.pos - 80) : e.pos + 80], e.msg))
    out = pd.DataFrame(rows, columns=["line", "column", "context", "message"])
    return out.astype({"line": "Int32", "column": "Int32"})


@F.pandas_udf(T.StringType())
def pretty(text: pd.Series) -> pd.Series:
    """Indented by two, or as it is where it isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return t if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2)
        except json.JSONDecodeError:
            return t

    return text.map(one)


def find_entry(value, wanted: str, keys: tuple[str, ...] = ("target_id", "id", "target")):
    """The first object, outside in, whose id - the first of its keys that isn't null, '' or [] - is wanted."""
    waiting = [value]
    while waiting:
        here = waiting.pop()
        if isinstance(here, dict):
            named = [here[k] for k in keys if here.get(k) not in (None, "", [])]
            if named and named[0] == wanted:
                return here
            waiting += reversed(here.values())
        elif isinstance(here, list):
            waiting += reversed(here)
    return None


@F.pandas_udf(T.StringType())
def find_entry_udf(text: pd.Series, wanted: pd.Series) -> pd.Series:
    def one(t: str | None, w: str | None) -> str | None:
        try:
            found = None if t is None or w is None else find_entry(json.loads(t), w)
        except json.JSONDecodeError:
            return None
        return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)

    return pd.Series([one(t, w) for t, w in zip(text, wanted, strict=True)], dtype=object)


def output_schema(paths: list[str]) -> dict:
    """JSON Schema of a reply that holds exactly the given files."""
    # Fixed value: the schema that is sent with a request.
    return {
        "type": "object",
        "properties": {
            "files": {
                "type": "array",
                "items": {"type": "object", "properties": {"path": {"type": "string", "enum": paths}, "content": {"type": "string"}}, "required": ["path", "content"], "additionalProperties": False},
                "minItems": len(paths),
                "maxItems": len(paths),
            }
        },
        "required": ["files"],
        "additionalProperties": False,
    }

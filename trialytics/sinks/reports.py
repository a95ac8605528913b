"""Report sinks for aggregated, ordered results: CSV, JSON, Markdown, SVG, manifests.

Rows come to the driver one partition at a time, through toLocalIterator; wide data goes to
write_csv_dataset, which stays distributed.
"""

from __future__ import annotations

import csv
import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialytics.functions.fmt import ABSENT, markdown_cell

ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """One file with a header; booleans as True and False, nulls empty, arrays joined with '; '."""
    names = list(columns or df.columns)
    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(names)
        for row in df.select(*names).toLocalIterator():
            writer.writerow(["" if v is None else "; ".join(map(str, v)) if isinstance(v, list) else v for v in row])


def write_csv_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8", newline="\n")


def rows_as_json(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]


def markdown_table(df: DataFrame, titles: Mapping[str, str] | None = None, newline: str = " ") -> str:
    """A table of all rows in order; cells are escaped by Spark."""
    names = list((titles or {c: c for c in df.columns}).items())
    lines = ["| " + " | ".join(t for _, t in names) + " |", "|" + "---|" * len(names)]
    cells = F.concat_ws(" | ", *(markdown_cell(c, newline) for c, _ in names))
    lines += [f"| {r[0]} |" for r in df.select(cells).toLocalIterator()]
    return "\n".join(lines) + "\n"


def fenced(text: str, language: str = "") -> str:
    longest = max((len(run) for run in "".join(c if c == "`" else " " for c in text).split()), default=0)
    fence = "`" * max(3, longest + 1)
    return f"{fence}{language}\n{text}\n{fence}\n"


def collapsible(title: str, text: str, language: str = "") -> str:
    return f"<details>\n<summary>{escape(title)}</summary>\n\n{fenced(text, language)}\n</details>\n"


def escape(text: str) -> str:
    return "".join(ENTITIES.get(c, c) for c in text)


# The chart's width, margins (left, right, top, below), rows and bars, in pixels.
CHART = {"width": 960, "left": 240, "right": 80, "top": 90, "below": 70, "row": 52, "bar": 28}


def svg_bars(title: str, bars: Iterable[tuple[str, float]], unit: str = "") -> str:
    """Horizontal bars, scaled to the largest value (1 if none is positive)."""
    bars = list(bars)
    most = max((v for _, v in bars), default=1.0)
    room = CHART["width"] - CHART["left"] - CHART["right"]
    height = CHART["top"] + CHART["row"] * len(bars) + CHART["below"]

    def label(x: float, y: float, words: str, size: int = 16, **more: str) -> str:
        extra = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in more.items())
        return f'<text x="{x}" y="{y}" font-family="sans-serif" font-size="{size}"{extra}>{escape(words)}</text>'

    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{CHART["width"]}" height="{height}" viewBox="0 0 {CHART["width"]} {height}">', '<rect width="100%" height="100%" fill="white"/>']
    out.append(label(CHART["width"] / 2, 42, title, 24, text_anchor="middle", font_weight="bold"))
    for place, (name, value) in enumerate(bars):
        top = CHART["top"] + place * CHART["row"]
        line, length = top + CHART["bar"] - 6, room * value / (most if most > 0 else 1.0)
        out.append(label(CHART["left"] - 12, line, name, text_anchor="end"))
        out.append(f'<rect x="{CHART["left"]}" y="{top}" width="{length:.2f}" height="{CHART["bar"]}" fill="#4c78a8"/>')
        out.append(label(round(CHART["left"] + length + 8, 2), line, f"{value:g}{unit}"))
    return "\n".join([*out, "</svg>"]) + "\n"


def manifest(paths: Iterable[str], root: str | None = None) -> list[dict]:
    """path (relative to root where it lies below it), bytes and SHA-256 of outputs on the driver."""
    out = []
    for path in map(Path, paths):
        data = path.read_bytes()
        named = path.relative_to(root) if root and path.is_relative_to(root) else path
        out.append({"path": named.as_posix(), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    return out


def utc_now() -> str:
    """The present time in ISO 8601, in UTC with its offset."""
    return datetime.now(UTC).isoformat()


def or_absent(value: object) -> str:
    return ABSENT if value in (None, "") else str(value)

"""Markdown tables as table functions: of a text, or of lines that come one by one; operators.catalog.table_rows is the same over DataFrame operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

SEPARATOR = re.compile(r":?-{3,}:?")


def cells_of(line: str) -> list[str] | None:
    line = line.strip()
    return [c.strip() for c in line.strip("|").split("|")] if line.startswith("|") else None


def tables(text: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(table_no, row_no, header, cells), numbers from 1."""
    number, run = 0, []

    def table() -> list[tuple[list[str], list[str]]]:
        rule = next((i for i in range(1, len(run)) if all(SEPARATOR.fullmatch(c) for c in run[i])), len(run))
        return [(run[rule - 1], cells) for cells in run[rule + 1 :]]

    for cells in [*map(cells_of, text.splitlines()), None]:
        if run and (cells is None or len(cells) != len(run[0])):
            found = table()
            number += bool(found)
            yield from ((number, i, header, row) for i, (header, row) in enumerate(found, 1))
            run = []
        if cells is not None:
            run.append(cells)


ROWS = T.StructType([T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("header", T.ArrayType(T.StringType())), T.StructField("cells", T.ArrayType(T.StringType()))])


@udtf(returnType=ROWS)
class MarkdownTables:
    def eval(self, text: str):
        if text is not None:
            yield from tables(text)


@udtf(returnType=T.StructType([T.StructField("path", T.StringType()), *ROWS]))
class MarkdownLines:
    """Rows of the tables in the lines (path, line) of a partition, a document's in order. Of what has passed only the last line and the present table's header are kept, so that a document never stands in one value or in memory."""

    def __init__(self):
        self.table_no = self.row_no = 0
        self.last = self.header = None

    def eval(self, row: Row):
        cells = None if row["line"] is None else cells_of(row["line"])
        if cells is None or self.last is None or len(cells) != len(self.last):
            self.header = None  # another run begins, or none
        elif self.header is not None:
            self.row_no += 1
            self.table_no += self.row_no == 1
            yield row["path"], self.table_no, self.row_no, self.header, cells
        elif all(SEPARATOR.fullmatch(c) for c in cells):
            self.header, self.row_no = self.last, 0
        self.last = cells


def tables_of_lines(lines: DataFrame, path: str, order: str, line: str) -> DataFrame:
    """path, table_no, row_no, header, cells of lines (path, order, line): all lines of a document, table or not, in a partition of its own."""
    named = lines.selectExpr(f"cast({path} as string) as path", f"{order} as place", f"{line} as line")
    return MarkdownLines(named.asTable().partitionBy("path").orderBy("place"))

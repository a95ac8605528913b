"""Quality rules: what a document says of itself, and lines that too many documents of its host share.

One pass over the texts gives each document's base measures and, once each, the 128-bit hashes
of its normalised lines with the words they hold (measure). A line is normalised to its words,
parted by single spaces, with A-Z in lower case and every run of digits as 0. Then

- documents that are equal in id, host and text are reduced to one;
- a line's documents are counted by host, which each document enters once a line;
- a line is common where its documents number more than `least` and more than `percent` of a
  hundred of the host's documents;
- common lines are removed from each document, in all their places;
- a document is rejected that fails the base rules, or of whose words less than half stay.

Base rules (failed): fewer than 50 words, or more than half of the words in 3-word windows
that the text holds twice or more.

Only hashes are shuffled, never texts: once by document, once by host and line (counted before
the shuffle), and once more to find the documents of common lines, in a join that Spark splits
where a line is very common, or does without a shuffle where the table of common lines lies
below its own broadcast threshold. cleaned() shuffles the texts once, of documents with a common line.

Nulls and edge cases: a null text is an empty one, without words or lines, and fails. Documents
of a null host count as one host's. A null id is an id; rows of one id with different texts or
hosts are documents apart, rows equal in all three are one document and come out alike. An empty
table gives no rows. Lines without a word are never counted or removed. Further columns are kept
by cleaned() and ignored by verdicts(); input columns that begin with `_q_` come back as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import cut
from trialytics.session import prepare

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
DIGITS = re.compile(rb"[0-9]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KEYS = ("_q_id", "_q_host", "_q_text")


def line_hash(line: bytes) -> bytes:
    """16 bytes of a line's normal form, which is never empty; an empty one for a line without words."""
    words = line.lower().split()
    return xxhash.xxh3_128_digest(DIGITS.sub(b"0", b" ".join(words))) if words else b""


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three which the sequence holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pairs = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three ids would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + 3, -1)
    return int((np.cumsum(inside) > 0).sum())


def measure(data: bytes, n_chars: int) -> tuple[tuple[int, ...], dict[bytes, int]]:
    """The base measures of a text of n_chars code points, and the words of its lines by hash."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    shared: dict[bytes, int] = {}
    for line in lines:
        key = line_hash(line)
        shared[key] = shared.get(key, 0) + len(line.split())
    blanks = len(data) - sum(map(len, words))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (len(words), n_chars - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)), shared


def _host(host_col: str) -> Column:
    """A host's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("-"))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """KEYS, MEASURES, and the distinct lines as _q_high, _q_low (hash halves) and _q_in (words), a row a document."""
    prepare(docs.sparkSession)
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    fields = [("_q_id", docs.schema[id_col].dataType), ("_q_host", T.StringType()), ("_q_text", long), *((m, long) for m in MEASURES), ("_q_high", longs), ("_q_low", longs), ("_q_in", longs)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, hashes, inside, ends = [], [], [], [0]
            for text in batch.column(3).to_pylist():
                text = text or ""
                own, shared = measure(text.encode(), len(text))
                base.append(own)
                hashes.extend(shared)
                inside.extend(shared.values())
                ends.append(len(hashes))
            halves = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (halves[:, 0], halves[:, 1], inside)]
            columns = np.array(base, dtype=np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c) for c in columns), *listed], names=schema.names)

    return docs.select(F.col(id_col).alias("_q_id"), _host(host_col).alias("_q_host"), _text_key(text_col).alias("_q_text"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def document_lines(rows: DataFrame) -> DataFrame:
    """KEYS, high, low, words: each line of each document once; rows: of measured()."""
    once = rows.select(*KEYS, "_q_high", "_q_low", "_q_in").dropDuplicates(list(KEYS))
    line = F.explode(F.arrays_zip("_q_high", "_q_low", "_q_in")).alias("l")
    return once.select(*KEYS, line).select(*KEYS, F.col("l._q_high").alias("high"), F.col("l._q_low").alias("low"), F.col("l._q_in").alias("words"))


def common_lines(rows: DataFrame, least: int = 5, percent: int = 10) -> DataFrame:
    """_q_host, high, low, documents: the lines above both limits, by host. rows: of measured()."""
    hosts = rows.select(*KEYS).distinct().groupBy("_q_host").agg(F.count("*").alias("of"))
    counted = document_lines(rows).groupBy("_q_host", "high", "low").agg(F.count("*").alias("documents")).where(F.col("documents") > least)
    return counted.join(hosts, "_q_host").where(100 * F.col("documents") > percent * F.col("of")).select("_q_host", "high", "low", "documents")


def _same(left: str, right: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in KEYS))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, least: int, percent: int, with_hashes: bool) -> tuple[DataFrame, DataFrame]:
    """(measured rows, KEYS and what each document with a common line loses)."""
    rows = cut(measured(docs, id_col, text_col, host_col), "measured")
    common = cut(common_lines(rows, least, percent), "common")
    found = document_lines(rows).join(common, ["_q_host", "high", "low"])
    hashes = [F.collect_list(F.struct("high", "low")).alias("_q_common")] if with_hashes else []
    return rows, found.groupBy(*KEYS).agg(F.sum("words").alias("_q_lost"), *hashes)


def _verdict(least_words: int, repeat_percent: int) -> tuple[Column, Column]:
    failed = base_failed(least_words, repeat_percent)
    return failed, ~failed & (2 * F.col("_q_lost") <= F.col("n_words"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = 5, percent: int = 10, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """A row a document: id, the MEASURES, base_failed, n_common_words (words in common lines), kept."""
    rows, lost = _judged(docs, id_col, text_col, host_col, least, percent, False)
    joined = rows.select(*KEYS, *MEASURES).alias("r").join(lost.alias("l"), _same("r", "l"), "left").select("r.*", F.coalesce("l._q_lost", F.lit(0).cast("bigint")).alias("_q_lost"))
    failed, kept = _verdict(least_words, repeat_percent)
    return joined.select(F.col("_q_id").alias(id_col), *MEASURES, failed.alias("base_failed"), F.col("_q_lost").alias("n_common_words"), kept.alias("kept"))


@F.pandas_udf(T.StringType())
def _without(text, common):
    """text without the lines whose hashes common lists; as it is where that is null."""
    import pandas as pd

    def one(value: str, hashes) -> str:
        gone = {np.array([h["high"], h["low"]], dtype=">i8").tobytes() for h in hashes}
        return "\n".join(line for line in value.split("\n") if line_hash(line.encode()) not in gone)

    return pd.Series([t if t is None or c is None else one(t, c) for t, c in zip(text, common, strict=True)], dtype=object)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = 5, percent: int = 10, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """docs of which common lines are removed and rejected documents left out; columns as they were, but for the text."""
    rows, lost = _judged(docs, id_col, text_col, host_col, least, percent, True)
    joined = rows.select(*KEYS, *MEASURES).dropDuplicates(list(KEYS)).alias("r").join(lost.alias("l"), _same("r", "l"), "left").select("r.*", F.coalesce("l._q_lost", F.lit(0).cast("bigint")).alias("_q_lost"), "l._q_common")
    stay = joined.where(_verdict(least_words, repeat_percent)[1]).select(*KEYS, "_q_common")
    # the input's columns travel as one struct, whatever their names
    marked = docs.select(F.struct(*docs.columns).alias("_q_row"), F.col(id_col).alias("_q_id"), _host(host_col).alias("_q_host"), _text_key(text_col).alias("_q_text"))
    both = marked.alias("r").join(stay.alias("l"), _same("r", "l")).select("r._q_row", "l._q_common")
    return both.select(*(_without(F.col("_q_row")[text_col], F.col("_q_common")).alias(c) if c == text_col else F.col("_q_row")[c].alias(c) for c in docs.columns))

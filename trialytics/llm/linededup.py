"""Line de-duplication by winnowing over line hashes. DataFrame operations only.

A document is its lines, trimmed; blank lines are skipped over. A window is a run of
neighbouring lines of at least min_words words that can't do without its first or its last
line: from each line the shortest run onward, and to each line the shortest run before it.
Each window selects the line of the smallest hash in it (the first, if several), and the
selected positions, each once, are the document's fingerprints. Any two equal runs of min_words
words or more share a window, select the same line of it, and so share a fingerprint: the
guarantee of winnowing. (A single line of min_words words is a window.)

First only fingerprints are made and counted by hash: a hash that stands at one position of
the corpus can't belong to a repeated run, and its windows are done with. Of the positions
that are left, the windows that selected them are verified: joined by the selected hash and
the digest of all the window's lines to their first position in the order of (id, line).
Matched windows of a document that lie on one diagonal - the same distance to the same earlier
document - and touch are one match, which so extends to both sides line by line: every line of
a maximal match lies in a window of that match, that from it onward or that which ends the
match, so that no line is left over. The matches are deleted: of every repeated run of at
least min_words words all occurrences but the first.

A fingerprint of very many documents is reduced to its first position before it is shuffled,
and its occurrences meet that one row: no pairs within a group are made. Lines go through the
shared folder once, as hashes; texts are shuffled once, to be cut.

Nulls and edge cases: null and empty texts have no lines and stay as they are. Rows with a
null id take no part and stay. Rows that share an id are kept apart by their text and count as
documents in text order; rows equal in both are one document more than once and come out alike.
An empty table gives no rows. Further columns are kept. The operator's own columns are called
as in OWN; where docs has a column of such a name, the operator's gets one more underscore in
front (own_names), and the input's column stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialytics.llm.common import cut, own_names

OWN = ("_w_lines", "_w_removed", "_w_runs")

#: White space inside lines: it is trimmed, and separates words (fixed values).
BLANK = " \t\x0b\f\r"
WORDS = r"[^ \t\x0B\f\r]+"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_w_id, _w_text (a hash that keeps apart rows of one id), _w_line (place), _w_hash, _w_key, _w_n (words) of all lines with words."""
    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("_w_id"), F.xxhash64(text_col).alias("_w_text"), F.posexplode(split_lines(F.col(text_col))).alias("_w_line", "line"))
    line = rows.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.length("line") > 0)
    # single spaces are counted without a pattern, which most lines need no more than
    odd = reduce(Column.__or__, (F.col("line").contains(x) for x in ("  ", *BLANK[1:])))
    words = F.when(odd, F.regexp_count("line", F.lit(WORDS))).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return line.select("_w_id", "_w_text", "_w_line", F.xxhash64("line").alias("_w_hash"), F.unhex(F.md5(F.col("line").cast("binary"))).alias("_w_key"), words.cast("long").alias("_w_n"))


def windows(lines: DataFrame, min_words: int, with_content: bool) -> DataFrame:
    """The windows of each document: _w_first, _w_last (line places), _w_select (hash, line, live: the selected line), with_content also _w_content.

    lines: _w_id, _w_text, _w_line, _w_hash, _w_n, _w_live and for the content _w_key, each line once, partitioned by document.
    """
    doc = Window.partitionBy("_w_id", "_w_text")
    run = doc.orderBy("_w_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("_w_after", F.sum("_w_n").over(run)).withColumn("_w_before", F.col("_w_after") - F.col("_w_n"))
    made = []
    for order, frame in (("_w_before", (0, min_words - 1)), ("_w_after", (1 - min_words, 0))):
        span = doc.orderBy(order).rangeBetween(*frame)
        chosen = F.min(F.struct(F.col("_w_hash").alias("hash"), F.col("_w_line").alias("line"), F.col("_w_live").alias("live"))).over(span)
        content = [F.unhex(F.md5(F.concat_ws("", F.transform(F.collect_list("_w_key").over(span), F.hex)).cast("binary"))).alias("content")] if with_content else []
        made.append(F.struct(F.sum("_w_n").over(span).alias("n"), F.min("_w_line").over(span).alias("first"), F.max("_w_line").over(span).alias("last"), chosen.alias("select"), *content))
    both = placed.select("_w_id", "_w_text", made[0].alias("_w_onward"), made[1].alias("_w_back"))
    both = both.select("_w_id", "_w_text", F.explode(F.array_distinct(F.array("_w_onward", "_w_back"))).alias("w")).where(F.col("w.n") >= min_words)
    names = ["first", "last", "select", *(["content"] if with_content else [])]
    return both.select("_w_id", "_w_text", *(F.col(f"w.{n}").alias(f"_w_{n}") for n in names))


def live_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """The windows whose fingerprint stands at several positions, with their content. lines: of document_lines."""
    own = ("_w_id", "_w_text", "_w_line")
    once = lines.select(*own, "_w_hash", "_w_n").repartition("_w_id", "_w_text").dropDuplicates(own)
    picked = windows(once.withColumn("_w_live", F.lit(False)), min_words, False)
    marks = picked.select("_w_id", "_w_text", F.col("_w_select.line").alias("_w_line"), F.col("_w_select.hash").alias("_w_hash")).distinct()
    marks = cut(marks, "fingerprints")
    several = cut(marks.groupBy("_w_hash").agg(F.count("*").alias("_w_times")).where("_w_times > 1").select("_w_hash"), "several")
    live = marks.join(several.hint("merge"), "_w_hash", "left_semi").select(*own)
    # a live position is one more row of its line; the group brings both together
    rows = lines.withColumn("_w_live", F.lit(False)).unionByName(live.withColumn("_w_live", F.lit(True)), allowMissingColumns=True).repartition("_w_id", "_w_text")
    flagged = rows.groupBy(*own).agg(F.max("_w_hash").alias("_w_hash"), F.max("_w_key").alias("_w_key"), F.max("_w_n").alias("_w_n"), F.max("_w_live").alias("_w_live"))
    some = flagged.withColumn("_w_some", F.max("_w_live").over(Window.partitionBy("_w_id", "_w_text"))).where("_w_some").drop("_w_some")
    return windows(some, min_words, True).where("_w_select.live").withColumn("_w_select", F.col("_w_select.hash"))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_w_id, _w_text, _w_from, _w_to: the maximal runs of lines to delete."""
    found = cut(live_windows(cut(document_lines(docs, id_col, text_col), "lines"), min_words), "windows")
    place = F.struct("_w_id", "_w_text", "_w_first")
    first = cut(found.groupBy("_w_select", "_w_content").agg(F.min(place).alias("_w_at"), F.count("*").alias("_w_times")).where("_w_times > 1").drop("_w_times"), "first")
    later = found.join(first.hint("merge"), ["_w_select", "_w_content"]).where(F.col("_w_at") < place)
    diagonal = Window.partitionBy("_w_id", "_w_text", "_w_at._w_id", "_w_at._w_text", F.col("_w_first") - F.col("_w_at._w_first")).orderBy("_w_first", "_w_last")
    reach = F.max("_w_last").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    chained = later.select("_w_id", "_w_text", "_w_first", "_w_last", F.col("_w_at._w_id").alias("_w_other"), F.col("_w_at._w_text").alias("_w_other_text"), (F.col("_w_first") - F.col("_w_at._w_first")).alias("_w_shift"), F.when(F.col("_w_first") <= reach + 1, 0).otherwise(1).alias("_w_new"))
    along = Window.partitionBy("_w_id", "_w_text", "_w_other", "_w_other_text", "_w_shift").orderBy("_w_first", "_w_last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matches = chained.withColumn("_w_run", F.sum("_w_new").over(along)).groupBy("_w_id", "_w_text", "_w_other", "_w_other_text", "_w_shift", "_w_run").agg(F.min("_w_first").alias("_w_from"), F.max("_w_last").alias("_w_to"))
    doc = Window.partitionBy("_w_id", "_w_text").orderBy("_w_from", "_w_to")
    before = F.max("_w_to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    merged = matches.withColumn("_w_new", F.when(F.col("_w_from") <= before + 1, 0).otherwise(1)).withColumn("_w_run", F.sum("_w_new").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return merged.groupBy("_w_id", "_w_text", "_w_run").agg(F.min("_w_from").alias("_w_from"), F.max("_w_to").alias("_w_to")).drop("_w_run")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rid of repeated runs, and the columns of OWN: _w_lines (lines before), _w_removed (lines deleted), _w_runs (runs deleted).

    Blank lines inside a deleted run go with it.
    """
    own = own_names(docs, OWN)
    key, gone, lines = own_names(docs, ("_w_text", "_w_gone", "_w_all")).values()
    runs = repeated_runs(docs, min_words, id_col, text_col)
    deleted = runs.groupBy(F.col("_w_id").alias(id_col), F.col("_w_text").alias(key)).agg(F.flatten(F.collect_list(F.sequence("_w_from", "_w_to"))).alias(gone), F.count("*").alias(own["_w_runs"]))
    joined = docs.withColumn(key, F.xxhash64(text_col)).join(deleted, [id_col, key], "left").withColumn(lines, split_lines(F.col(text_col)))
    size = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), size - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.col(lines)[i]), "\n"))
    out = {c: F.col(c) for c in docs.columns}
    out[text_col] = text.alias(text_col)
    counts = {"_w_lines": F.when(F.col(text_col).isNull(), 0).otherwise(size).cast("long"), "_w_removed": F.coalesce(F.size(F.array_distinct(gone)), F.lit(0)).cast("long"), "_w_runs": F.coalesce(own["_w_runs"], F.lit(0))}
    return joined.select(*out.values(), *(value.alias(own[name]) for name, value in counts.items()))

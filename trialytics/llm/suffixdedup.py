"""Suffix-array de-duplication: every byte that a string of `length` bytes covers which starts anywhere else too.

All occurrences of a string must meet in one shard's suffix array. Each window of `length`
bytes has an anchor, the place of the least hash among its `gram`-byte substrings (the
rightmost, if several), so equal windows have equal anchors, and a text's windows fall into
segments of neighbouring windows with one anchor. Segments whose anchor substring is unique in
the corpus hold nothing repeated. Where all segments of an anchor are equal, or a segment
occurs more than once as a whole, all its windows are repeated. What is left - distinct
segments around a common anchor, one of each - is dealt over shards by anchor, and each shard
is settled exactly by a suffix array with common-prefix values, from external induced sorting
(suffixarray.py): a window is repeated if the values beside it reach `length`.

Skew: anchors are counted with partial aggregation, and equal segments enter a shard once,
whatever their number. An anchor with more than `crowd` distinct segments, such as a passage
in very many surroundings, isn't put into one shard: its windows are counted by their 128-bit
digests instead, which spreads them over all tasks.

Hashes that decide: segments are held equal by 64-bit anchor hash and 64-bit digest together.

Shards are about `shard_bytes` and their queues keep `room` tuples in memory, less than a shard
has, so that they spill to the shared folder; a shard's text and its types lie in memory.

Nulls and edge cases: a null text is empty; texts shorter than `length` lose nothing. Rows with
a null id take part like others. Rows of one id are kept apart by a 128-bit digest of their
text; wholly repeated rows are documents that repeat each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import cut, mix64, shared_folder
from trialytics.llm.suffixarray import repeated_starts
from trialytics.session import prepare

#: Odd base of the substring hash (fixed value).
BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 20
STRETCH = 1 << 19


class Anchors:
    """Segments of a text's windows by anchor."""

    def __init__(self, length: int, gram: int = 64):
        if gram & (gram - 1) or not gram <= length // 2:
            raise ValueError("gram is a power of two, at most half of length")
        self.length, self.gram, self.wide = length, gram, length - gram + 1
        self.table = np.random.default_rng(20240301).integers(1, 1 << 63, 256).astype(np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of each gram, by doubling."""
        out, step = self.table[data], 1
        while step < self.gram:
            out = out[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + out[step:]
            step *= 2
        return mix64(out)

    def segments(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, last window) of each segment, in text order."""
        found = [self._segments(data[at : at + STRETCH + self.length - 1], at) for at in range(0, max(1, len(data) - self.length + 1), STRETCH)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _segments(self, data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) < self.length:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none
        hashes = self.hashes(data)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))
        step = 1
        while step * 2 <= self.wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if rest := self.wide - step:
            least = np.minimum(least[:-rest], least[rest:])
        place = (mask - (least & mask)).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.append(0, change), np.append(change - 1, len(place) - 1)
        return hashes[place[first]], first + base, last + base


def _digest(data: memoryview | bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def repeated_windows(docs: DataFrame, length: int, gram: int = 64, shard_bytes: int = 2 << 20, room: int = 1 << 19, crowd: int = 4096) -> DataFrame:
    """id, key, first, last: ranges of window starts whose windows occur more than once. docs: id, key, text (no nulls in text)."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["id"].dataType
    own = [T.StructField("id", kind), T.StructField("key", T.BinaryType())]
    whole = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    found = T.StructType([*whole("anchor", "segment"), *own, *whole("first", "last")])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            rows, hashes, firsts, lasts, digests = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode()
                if len(data) < length:
                    continue
                anchor, first, last = anchors.segments(np.frombuffer(data, dtype=np.uint8))
                view = memoryview(data)
                digests += [_digest(view[a : b + length], 8) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                rows.append(np.full(len(first), row))
                hashes.append(anchor)
                firsts.append(first)
                lasts.append(last)
            if rows:
                index = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.frombuffer(b"".join(digests), dtype=np.int64)), batch.column(0).take(index),
                    batch.column(1).take(index), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(lasts))], names=found.names)

    segments = cut(docs.mapInArrow(find, found), "segments")
    # written, so that the join below stands on plain exchanges, whose large partitions Spark can split
    counted = cut(segments.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("segment") != F.max("segment")).alias("mixed")).where("n > 1").drop("n"), "counted")
    repeated = cut(segments.join(counted.hint("merge"), "anchor"), "repeated")
    equal = repeated.where("not mixed").select("id", "key", "first", "last")
    mixed = repeated.where("mixed")
    kinds = mixed.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "first", "last")).alias("at"))
    kinds = cut(kinds, "segment-kinds")
    crowds = cut(kinds.groupBy("anchor").agg((F.count("*") > crowd).alias("crowded")), "crowds")
    kinds = cut(kinds.join(crowds.hint("merge"), "anchor"), "kinds")
    copied = cut(mixed.join(kinds.where("n > 1").select("anchor", "segment").hint("merge"), ["anchor", "segment"], "left_semi").select("id", "key", "first", "last"), "copied")

    total = kinds.select(F.sum(F.expr(f"at.last - at.first + {length}"))).head()[0] or 0
    shards = max(1, total // shard_bytes)
    listed = kinds.groupBy(F.col("at.id").alias("id"), F.col("at.key").alias("key")).agg(F.collect_list(F.struct(F.pmod("anchor", F.lit(shards)).alias("shard"), F.col("at.first").alias("first"), F.col("at.last").alias("last"), (F.col("n") == 1).alias("open"), "crowded")).alias("parts"))
    fetched = T.StructType([T.StructField("shard", T.LongType()), *own, *whole("first", "last"), T.StructField("open", T.BooleanType()), T.StructField("data", T.BinaryType())])

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each segment, with its bytes; for a crowded anchor's a row for each window, without shard, with its digest."""
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (text, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                data, out = text.encode(), []
                for p in parts:
                    if p["crowded"]:
                        out += [(None, s, s, p["open"], _digest(data[s : s + length], 16)) for s in range(p["first"], p["last"] + 1)]
                    else:
                        out.append((p["shard"], p["first"], p["last"], p["open"], data[p["first"] : p["last"] + length]))
                shard, first, last, is_open, piece = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([ids[row]] * len(out), batch.column(0).type), pa.array([keys[row]] * len(out), pa.binary()),
                    pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(is_open, pa.bool_()), pa.array(piece, pa.binary())], names=fetched.names)

    same = F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.key") == F.col("l.key"))
    joined = docs.alias("d").join(listed.alias("l"), same).select("d.id", "d.key", "d.text", "l.parts")
    pieces = cut(joined.mapInArrow(fetch, fetched), "pieces")
    ranges = T.StructType([*own, *whole("first", "last")])
    scratch = shared_folder(spark, "suffix-queues")

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards in order of arrival: their segments are sorted as one text."""
        from pyspark import TaskContext

        context, now, rows = TaskContext.get(), None, []

        def done() -> Iterator[pa.RecordBatch]:
            folder = f"{scratch}/{context.partitionId()}-{context.taskAttemptId()}-{now}"
            out = []
            for (doc_id, key, first, _, is_open, _), starts in zip(rows, repeated_starts([r[5] for r in rows], length, folder, room), strict=True):
                if is_open and len(starts):
                    breaks = np.flatnonzero(np.diff(starts) != 1)
                    for a, b in zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True):
                        out.append((doc_id, key, first + a, first + b))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.binary(), pa.int64(), pa.int64()), strict=True)], names=ranges.names)

        for batch in batches:
            id_type = batch.column(1).type
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and rows:
                    yield from done()
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield from done()

    parts = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    settled = pieces.where("shard is not null").repartition(int(parts), "shard").sortWithinPartitions("shard").mapInArrow(settle, ranges)
    windows = pieces.where("shard is null")
    often = cut(windows.groupBy("data").agg(F.count("*").alias("n")).where("n > 1").select("data"), "often")
    counted_windows = cut(windows.where("open").join(often.hint("merge"), "data", "left_semi").select("id", "key", "first", "last"), "counted-windows")
    return equal.unionByName(copied).unionByName(settled).unionByName(counted_windows)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run), and with with_kept the bytes that stay."""
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    ranges = repeated_windows(rows, length, **options).groupBy("id", "key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span)), *([T.StructField("kept", T.BinaryType())] if with_kept else [])])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), *([pa.binary()] if with_kept else [])]
        for batch in batches:
            out = []
            for value, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs = value.encode(), []
                for first, last in sorted((r["first"], r["last"]) for r in found or ()):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], last + length)
                    else:
                        runs.append([first, last + length])
                edges = [0, *(e for r in runs for e in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else data
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], *([kept] if with_kept else [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=schema.names)

    same = F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.key") == F.col("r.key"))
    return rows.alias("d").join(ranges.alias("r"), same, "left").select("d.id", "d.text", "r.ranges").mapInArrow(apply, schema)

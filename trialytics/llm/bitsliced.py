"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers, component by component, and stored in blocks as bit slices:
slice s of dimension d is a bitmap with a bit for each row of the block. A query's scores are
put together for all rows of a block at once by bitmap arithmetic: every slice, weighted by
every digit of the query's component, is an addend in the column of its power of two, and
carry-save adders reduce the columns to the slices of the sum. The best k rows are then picked
from the most significant slice of the sum downward; only the rows that tie at the boundary
are resolved one by one. All arithmetic is on integers, so results are exact.

Scale: the index is built in one shuffle into blocks of block_rows rows, the queries into
blocks too. A stated query set meets all rows on a grid of cells, each a partition of its own
by number: the index is dealt over the grid's rows, the queries over its columns, column_queries
at most in each; a cell holds its queries in memory while its index blocks stream past. So the
index is sent once for each column and the queries once for each row, no join key gathers
anything, and each meeting of blocks yields at most k rows a query.

Nulls and edge cases: rows whose id is null, and vectors that are null or hold null or
non-finite components, take no part; vectors of different length have no product and are not
compared. A row is never a candidate of a query of its own id; repeated query rows are
answered each. A quantised component of 2**62 or more, or a score beyond a long, is an error.
Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialytics.session import prepare

INDEX = "dims int, bits int, ids binary, slices binary"
QUERIES = "dims int, query_ids binary, numbers binary, vectors binary"
FOUND = "query_id long, query_no long, vec_id long, score long"


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    scaled = np.floor(scale * values.astype(np.float64))
    if scaled.size and not np.abs(scaled).max() < 2.0**62:
        raise OverflowError("a component of a vector is too large to be quantised: 2**62 or more after scaling")
    return scaled.astype(np.int64)


def _long(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError("a score does not fit into a long")
    return score


def _vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, quantised rows) for each vector length in a batch."""
    kept: dict[int, tuple[list, list]] = {}
    for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if key is not None and vector is not None and None not in vector and all(map(math.isfinite, vector)):
            ids, rows = kept.setdefault(len(vector), ([], []))
            ids.append(key)
            rows.append(vector)
    for dims, (ids, rows) in kept.items():
        yield dims, np.array(ids, dtype=np.int64), quantise(np.array(rows, dtype=np.float64).reshape(len(ids), dims), scale)


def to_slices(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """Two's-complement slices [dimension, slice, word] of integer rows, and their number."""
    most = max((int(abs(v)) for v in (rows.min(), rows.max())), default=0) if rows.size else 0
    bits = most.bit_length() + 1
    words = -(-len(rows) // 64)
    out = np.zeros((rows.shape[1], bits, words), dtype=np.uint64)
    for s in range(bits):
        flags = ((rows >> min(s, 63)) & 1).astype(np.uint8).T
        packed = np.packbits(flags, axis=1, bitorder="little")
        padded = np.zeros((rows.shape[1], words * 8), dtype=np.uint8)
        padded[:, : packed.shape[1]] = packed
        out[:, s] = padded.view(np.uint64)
    return bits, out


def digits(value: int) -> list[tuple[int, int]]:
    """The non-adjacent form of value: (power of two, +1 or -1), few of them."""
    out, power = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((power, sign))
            value -= sign
        value >>= 1
        power += 1
    return out


def scores(slices: np.ndarray, query: list[int]) -> tuple[int, list[np.ndarray]]:
    """(offset, slices of the sums): a row's inner product is offset + its sum, read as an unsigned number."""
    columns: dict[int, list[np.ndarray]] = {}
    offset, bits = 0, slices.shape[1]
    for dimension, value in enumerate(query):
        for power, sign in digits(value):
            for s in range(bits):
                bitmap = slices[dimension, s]
                if (s == bits - 1) == (sign > 0):  # a negative weight: -b is (not b) - 1
                    bitmap = ~bitmap
                    offset -= 1 << (power + s)
                columns.setdefault(power + s, []).append(bitmap)
    out: list[np.ndarray] = []
    power, zero = 0, np.zeros(slices.shape[2], dtype=np.uint64)
    last = max(columns, default=-1)
    while power <= last:
        column = columns.pop(power, [])
        if len(column) > 1:
            last = max(last, power + 1)
        carries = columns.setdefault(power + 1, []) if len(column) > 1 else []
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            ab = a ^ b
            column.insert(0, ab ^ c)
            carries.append((a & b) | (ab & c))
        if len(column) == 2:
            a, b = column
            column = [a ^ b]
            carries.append(a & b)
        out.append(column[0] if column else zero)
        power += 1
    return offset, out


def top_rows(sums: list[np.ndarray], allowed: np.ndarray, ids: np.ndarray, offset: int, k: int) -> list[tuple[int, int]]:
    """The k best allowed rows as (score, id), ties to the smaller id."""
    sure, maybe = np.zeros_like(allowed), allowed
    for bitmap in reversed(sums):
        high = maybe & bitmap
        count = int(np.bitwise_count(sure | high).sum())
        if count > k:
            maybe = high
        else:
            sure, maybe = sure | high, maybe & ~bitmap
            if count == k:
                maybe = np.zeros_like(maybe)
                break
    read = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    picked, boundary = read(sure), read(maybe)
    room = k - len(picked)
    if room < len(boundary):  # all of one score: the smaller ids
        boundary = boundary[np.argsort(ids[boundary], kind="stable")[:room]]
    out = []
    for row in np.concatenate([picked, boundary]).tolist():
        word, bit = row >> 6, row & 63
        total = sum((int(s[word]) >> bit & 1) << power for power, s in enumerate(sums))
        out.append((offset + total, int(ids[row])))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block_rows: int = 32768) -> DataFrame:
    """One row per block of up to block_rows vectors of one length: dims, bits, ids, slices."""
    prepare(vectors.sparkSession)
    used = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    blocks = max(1, -(-used.count() // block_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dims: int, parts: list) -> pa.RecordBatch:
            ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            bits, slices = to_slices(rows)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([bits], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([slices.tobytes()], pa.binary())], names=["dims", "bits", "ids", "slices"])

        for batch in batches:
            for dims, ids, rows in _vectors(batch, scale):
                parts = waiting.setdefault(dims, [])
                parts.append((ids, rows))
                if sum(len(p[0]) for p in parts) >= block_rows:
                    yield block(dims, waiting.pop(dims))
        for dims, parts in waiting.items():
            yield block(dims, parts)

    return used.repartition(blocks).mapInArrow(run, INDEX)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block_rows: int = 32768, query_rows: int = 256, column_queries: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that the condition `queries` picks."""
    spark = prepare(vectors.sparkSession)
    asked = vectors.where(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    number = asked.count()
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-vectors.count() // block_rows))
    columns = max(1, -(-number // column_queries), min(-(-number // query_rows), -(-wanted // blocks)))
    rows = min(blocks, max(1, -(-wanted // columns)))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for dims, ids, found in _vectors(batch, scale):
                numbers = np.arange(number, number + len(ids), dtype=np.int64)
                number += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, numbers, found))], names=["dims", "query_ids", "numbers", "vectors"])

    def best(queries: dict, block: dict) -> pa.RecordBatch:
        ids = np.frombuffer(block["ids"], dtype=np.int64)
        slices = np.frombuffer(block["data"], dtype=np.uint64).reshape(block["dims"], block["bits"], -(-len(ids) // 64))
        query_ids, numbers = (np.frombuffer(queries[n], dtype=np.int64) for n in ("ids", "numbers"))
        asked_for = np.frombuffer(queries["data"], dtype=np.int64).reshape(len(query_ids), queries["dims"])
        out = []
        for query, number, vector in zip(query_ids.tolist(), numbers.tolist(), asked_for.tolist(), strict=True):
            packed = np.packbits(ids != query, bitorder="little")
            allowed = np.zeros(slices.shape[2] * 8, dtype=np.uint8)
            allowed[: len(packed)] = packed
            offset, sums = scores(slices, vector)
            out += [(query, number, i, _long(s)) for s, i in top_rows(sums, allowed.view(np.uint64), ids, offset, k)]
        found = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "query_no", "vec_id", "score"])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                if not row["indexed"]:
                    held.append(row)
                    continue
                for group in held:
                    if group["dims"] == row["dims"]:
                        yield best(group, row)

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grouped = asked.repartition(columns).mapInArrow(gather, QUERIES).withColumn("column", F.pmod(F.spark_partition_id(), F.lit(columns)))
    grouped = grouped.withColumn("row", upto(rows)).select((F.col("row") * columns + F.col("column")).alias("cell"), F.lit(False).alias("indexed"), "dims", F.lit(0).alias("bits"), F.col("query_ids").alias("ids"), "numbers", F.col("vectors").alias("data"))
    index = build_index(vectors, id_col, vector_col, scale, block_rows).withColumn("row", F.pmod(F.spark_partition_id(), F.lit(rows)))
    index = index.withColumn("column", upto(columns)).select((F.col("row") * columns + F.col("column")).alias("cell"), F.lit(True).alias("indexed"), "dims", "bits", "ids", F.lit(None).cast("binary").alias("numbers"), F.col("slices").alias("data"))
    cells = grouped.unionByName(index).repartitionById(rows * columns, "cell").sortWithinPartitions("indexed")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    found = cells.mapInArrow(answer, FOUND)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

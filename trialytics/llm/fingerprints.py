"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is a run of `width` UTF-8 bytes (a shorter text is one shingle, an empty one has
none). A sketch keeps the k smallest distinct 64-bit shingle hashes, and so it is a function
of the shingle set alone: equal texts have equal sketches, and the sketch of a union is what
`merge` makes of the parts' sketches, in any order. A sketch of fewer than k hashes is the
whole set, and every estimate from two such sketches is exact.

Nulls and edge cases: a null text is an empty one; two empty texts resemble each other with 1,
an empty and another text with 0. Repeated rows get a fingerprint each. An empty table gives
no rows. Very long texts take memory in proportion to their own length only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import mix64
from trialytics.session import prepare

#: Odd factor of the rolling hash (fixed value).
BASE = 0x9E3779B97F4A7C15
FULL = 1 << 64


class BottomK:
    """Sketches of byte strings."""

    def __init__(self, k: int = 256, width: int = 12):
        self.k, self.width = k, width
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(1, FULL, 256, dtype=np.uint64)

    def hashes(self, data: bytes) -> np.ndarray:
        """64-bit hashes of all shingles, in text order."""
        codes = self.table[np.frombuffer(data, dtype=np.uint8)]
        if not len(codes):
            return codes
        width = min(self.width, len(codes))
        count = len(codes) - width + 1
        total = np.zeros(count, dtype=np.uint64)
        step = np.uint64(BASE)
        for at in range(width):
            total *= step
            total += codes[at : at + count]
        return mix64(total + np.uint64(width))

    def sketch(self, data: bytes) -> np.ndarray:
        return self.lowest(self.hashes(data))

    def lowest(self, hashes: np.ndarray) -> np.ndarray:
        """The k smallest distinct hashes, ascending."""
        k = self.k
        if len(hashes) > 4 * k:
            few = hashes[hashes < np.uint64(min(FULL - 1, FULL // len(hashes) * 2 * k))]
            few = np.unique(few)
            if len(few) >= k:
                return few[:k]
        return np.unique(hashes)[:k]

    def merge(self, *sketches: np.ndarray) -> np.ndarray:
        """The sketch of the union of the sketched sets."""
        return np.unique(np.concatenate(sketches))[: self.k]

    def distinct(self, sketch: np.ndarray) -> float:
        """Estimated number of distinct shingles (exact below k)."""
        if len(sketch) < self.k:
            return float(len(sketch))
        return (self.k - 1) * (FULL / (float(sketch[-1]) + 1))

    def resemblance(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated size of the intersection over that of the union."""
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        union = self.merge(a, b)
        common = np.intersect1d(a, b, assume_unique=True)
        return float(np.count_nonzero(common <= union[-1])) / len(union)

    def containment(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated part of a's shingles that b has too."""
        if not len(a):
            return 1.0
        return min(1.0, self.resemblance(a, b) * self.distinct(self.merge(a, b)) / self.distinct(a))

    def to_hex(self, sketch: np.ndarray) -> str:
        return sketch.astype(">u8").tobytes().hex()

    def from_hex(self, text: str) -> np.ndarray:
        return np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 256, width: int = 12) -> DataFrame:
    """id, fingerprint (hex), n_shingles (estimate) of each row; nothing is shuffled."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = BottomK(k, width)
        for batch in batches:
            made = [maker.sketch((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(maker.to_hex, made), pa.string()), pa.array(map(maker.distinct, made), pa.float64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def splice(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def as_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """16 bytes for each (id, hash), in the same order."""
    both = np.stack([ids.astype(np.int64), hashes.astype(np.int64)], axis=1) ^ np.int64(-(1 << 63))
    return np.ascontiguousarray(both.astype(">i8")).view("S16").ravel()


def range_bounds(cuts: list[int]) -> tuple[np.ndarray, bool]:
    """The first key of each range but the first, ascending, and whether an id is cut: one that quantiles name m times gets m ranges."""
    values, times = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    pairs = set()
    for value, count in zip(values.tolist(), times.tolist(), strict=True):
        pairs.update((value, -(1 << 63) + (j << 64) // count) for j in range(count))
        if count > 1 and value < (1 << 63) - 1:
            pairs.add((value + 1, -(1 << 63)))
    ids, hashes = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return as_keys(np.array(ids, dtype=np.int64), np.array(hashes, dtype=np.int64)), bool((times > 1).any())


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 256, width: int = 12) -> DataFrame:
    """Fingerprints of every text and of its edited form (see splice; the text after is that of the next id, after the last the first).

    id_col is an integer. Ids alone give as many ranges as there are shuffle partitions; an id
    that fills several is cut by a hash of its texts. Each range is a partition of its own, by
    number. The driver learns the first (id, hash) of each range. Each text goes to its range
    once, and the first text of a range to the range before as well; there a task pairs
    neighbours as they stream by, in order. Rows of equal ids follow each other in text order,
    or where an id fills several ranges in order of the texts' hashes; rows with a null id come
    before all others.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    cuts = docs.select(key.alias("id")).select(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).head()[0]
    bounds, hot = range_bounds(cuts or [])
    order = F.xxhash64(text_col) if hot else F.lit(0).cast("long")  # texts are hashed only where an id has to be cut

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, as_keys(ids.to_numpy(), hashes.to_numpy()), side="right").astype(np.int32))

    found = docs.select(key.alias("id"), order.alias("hash"))
    firsts = found.groupBy(range_of("id", "hash").alias("range")).agg(F.min(F.struct("id", "hash")).alias("at")).orderBy("range").collect()
    before = {tuple(f["at"]): firsts[i - 1]["range"] for i, f in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, as_keys(ids.to_numpy(), hashes.to_numpy()), side="right").tolist()
        return pd.Series([[2 * o, 2 * before[i] + 1] if i in before else [2 * o] for o, i in zip(own, zip(ids.tolist(), hashes.tolist(), strict=True), strict=True)])

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, last = BottomK(k, width), None
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            out = []
            for place, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                own, after = divmod(place, 2)
                sketch = maker.sketch(text.encode()) if not after or last and last[0] == own else None
                if last and last[0] == own:
                    edited = splice(last[2], text).encode()
                    other = maker.sketch(edited)
                    out.append((last[1], len(last[2]), hashlib.sha256(edited).hexdigest(), maker.to_hex(last[3]), maker.to_hex(other), maker.resemblance(last[3], other), maker.resemblance(last[3], sketch)))
                last = None if after else (own, doc_id, text, sketch)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (batch.column(1).type, *types), strict=True)], names=schema.names)

    placed = docs.select(F.explode(places(key, order)).alias("_place"), order.alias("_order"), F.col(id_col), F.col(text_col).alias("_text"))
    ordered = placed.repartitionById(len(bounds) + 1, F.shiftright("_place", 1)).sortWithinPartitions("_place", id_col, "_order", "_text").drop("_order")
    return ordered.mapInArrow(pair, schema)

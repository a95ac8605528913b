"""Keyed lookups with an order: first match, candidates by priority, unique match, set equality.

None broadcasts a side by hand; Spark broadcasts sides below its own size threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(left: DataFrame, right: DataFrame, left_key: str, right_keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the first row of right, by order, that has the key in any of right_keys (nulls: no match)."""
    keys = F.explode(F.array_distinct(F.array_compact(F.array(*right_keys))))
    exploded = right.select(keys.alias(left_key), order, *values)
    best = exploded.groupBy(left_key).agg(F.min_by(F.struct(*values), order).alias("_v"))
    return left.join(best, left_key, "left").select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))


def by_priority(candidates: DataFrame, key: str, priority: str, value: str, usable: Column) -> DataFrame:
    """The usable candidate of least priority of each key."""
    return candidates.where(usable).groupBy(key).agg(F.min_by(value, priority).alias(value))


def resolve_directory(ids: DataFrame, directories: DataFrame, id_col: str = "target_id", configured: str = "configured", path: str = "path", excluded: str = "pilot-failures") -> DataFrame:
    """id, path: the configured directory, else '<id>-roundtrip', else the first in order that contains the id and isn't excluded.

    The two exact cases are equi-joins. Containment is looked for only for ids they leave.
    """
    base = F.substring_index(path, "/", -1)
    exact = ids.select(id_col, F.explode(F.array_compact(F.array(F.struct(F.lit(1).alias("p"), F.substring_index(configured, "/", -1).alias("base")), F.struct(F.lit(2).alias("p"), F.concat(id_col, F.lit("-roundtrip")).alias("base"))))).alias("c")).select(id_col, "c.p", "c.base")
    named = directories.select(F.col(path), base.alias("base"))
    found = exact.join(named, "base").groupBy(id_col).agg(F.min_by(path, F.struct("p", path)).alias(path))
    rest = ids.select(id_col).join(found, id_col, "left_anti")
    open_dirs = named.where(~F.col(path).contains(excluded))
    held = containing(rest.select(F.col(id_col).alias("key")), open_dirs.select(F.col("base").alias("key")))
    within = held.join(open_dirs, F.col("large") == F.col("base")).groupBy(F.col("small").alias(id_col)).agg(F.min(path).alias(path))
    return found.unionByName(within)


#: Keys of an automaton, and keys that pass it, in a cell at most, about.
AUTOMATON_KEYS, CELL_KEYS = 200_000, 1_000_000


def containing(small: DataFrame, large: DataFrame) -> DataFrame:
    """small, large: the pairs of different keys (column key of both sides) of which the large one contains the small one.

    An automaton finds all small keys in one pass over a large one, so that the work follows the
    letters and the rows the matches, whatever the keys share. The small keys are dealt into
    automata of a bounded size and the large keys into stretches; each automaton meets each
    stretch in a cell, in which its keys come first. Null keys don't match; an empty one is
    contained in an empty one.
    """
    sides = [df.where("key is not null").select("key").distinct() for df in (small, large)]
    blocks, stretches = (df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("long").alias("n")).scalar() for df, most in zip(sides, (AUTOMATON_KEYS, CELL_KEYS), strict=True))
    hashed = F.xxhash64("key")
    one = sides[0].withColumns({"blocks": blocks, "stretches": stretches}).select(F.pmod(hashed, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("stretches") - 1)).alias("stretch"), F.lit(False).alias("passes"), "key")
    two = sides[1].withColumns({"blocks": blocks, "stretches": stretches}).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(hashed, "stretches").alias("stretch"), F.lit(True).alias("passes"), "key")
    cells = one.unionByName(two).repartition("block", "stretch").sortWithinPartitions("block", "stretch", "passes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        cell, automaton, ready = None, None, False
        for batch in batches:
            found: list[tuple[str, str]] = []
            for block, stretch, passes, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != (block, stretch):
                    cell, automaton, ready = (block, stretch), ahocorasick.Automaton(), False
                    empty = False
                if not passes:
                    empty = empty or not key
                    if key:
                        automaton.add_word(key, key)
                    continue
                if not ready:
                    ready = automaton.make_automaton() is None
                if not key:
                    found += [("", "")] * empty
                elif len(automaton):
                    found += [(word, key) for word in {word for _, word in automaton.iter(key)}]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], names=["small", "large"])

    return cells.mapInArrow(run, "small string, large string")


def unique_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, id_col: str, value: str, contained_after_many: bool = True) -> DataFrame:
    """id, value: the only row of right with an equal key, else the only value of those that contain or are contained, else null.

    contained_after_many: whether several equal keys fall through to containment too. Both
    sides are reduced to their distinct keys before they meet, so that the work follows the
    number of different keys; equality is a hash join, containment is found by automata.
    """
    a = left.select(id_col, left_key.alias("_a"))
    keys = right.select(F.col(value).alias("_v"), right_key.alias("_b")).groupBy("_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    asked = a.select("_a").distinct().join(keys.select(F.col("_b").alias("_a"), "_n", F.col("_least").alias("_equal")), "_a", "left")
    settled = F.coalesce(F.col("_n") == 1 if contained_after_many else F.col("_n") >= 1, F.lit(False))
    rest, others = asked.where(~settled & F.col("_a").isNotNull()).select("_a"), keys.where("_b is not null").select("_b", "_least", "_most")
    one, two = rest.select(F.col("_a").alias("key")), others.select(F.col("_b").alias("key"))
    pairs = containing(one, two).toDF("_a", "_b").unionByName(containing(two, one).toDF("_b", "_a"))
    both = pairs.join(others, "_b")
    within = both.groupBy("_a").agg(F.min("_least").alias("_low"), F.max("_most").alias("_high")).where("_low = _high").select("_a", F.col("_low").alias("_within"))
    answer = asked.join(within, "_a", "left").select("_a", F.when(F.col("_n") == 1, F.col("_equal")).when(~settled, F.col("_within")).alias(value))
    return a.join(answer, "_a", "left").select(id_col, value)


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def same_sets(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """key, same: whether both sides hold the same set of values; keys of either side. One shuffle: no arrays are built."""
    rows = left.select(key, F.col(left_value).alias("v"), F.lit(1).alias("side")).unionByName(right.select(key, F.col(right_value).alias("v"), F.lit(2).alias("side")))
    sides = rows.groupBy(key, "v").agg(F.bit_or("side").alias("sides"))
    return sides.groupBy(key).agg(F.every(F.col("sides") == 3).alias("same"))


def verify(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, state: match, mismatch, missing or unexpected."""
    joined = expected.select(key, F.col(value).alias("_e"), F.lit(True).alias("_in_e")).join(actual.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), key, "full")
    return joined.select(key, F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "unexpected").when(F.col("_e").eqNullSafe(F.col("_a")), "match").otherwise("mismatch").alias("state"))

"""Group counts, pass rates and counters. `passed` is a nullable boolean column; totals count all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialytics.functions.coerce import _c
from trialytics.functions.stats import wilson


def group_key(x: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(x).cast("string"), F.lit("")), F.lit("unknown"))


def _rates(grouped, passed: Column) -> DataFrame:
    return _with_rates(grouped.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed")))


def _with_rates(out: DataFrame) -> DataFrame:
    low, high = wilson("passed", "total")
    return out.withColumns({"pass_rate": F.try_divide(F.col("passed").cast("double"), F.col("total").cast("double")), "wilson_95_low": low, "wilson_95_high": high})


def rates_of_counts(df: DataFrame, keys: Sequence[str], n: str, passed: Column) -> DataFrame:
    """keys with the columns of pass_rates, where a row stands for n rows."""
    sums = {"total": F.sum(n), "passed": F.sum(F.when(passed, F.col(n))), "failed": F.sum(F.when(~passed, F.col(n)))}
    return _with_rates(df.groupBy(*keys).agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items())))


def pass_rates(df: DataFrame, dimension: Column | str, passed: Column) -> DataFrame:
    """group, total, passed, failed, pass_rate and its Wilson interval."""
    return _rates(df.groupBy(group_key(dimension).alias("group")), passed)


def pass_rates_by(df: DataFrame, dimensions: Sequence[str], passed: Column) -> DataFrame:
    """The same for several dimensions in one scan and one shuffle: dimension, group, ..."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), group_key(d).alias("group")) for d in dimensions))
    long = df.select(F.explode(pairs).alias("g"), passed.alias("_passed")).select("g.dimension", "g.group", "_passed")
    return _rates(long.groupBy("dimension", "group"), F.col("_passed"))


def overall(df: DataFrame, passed: Column) -> DataFrame:
    return _rates(df.groupBy(), passed)


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def failure_counts(df: DataFrame, key: Column | str, failed: Column, by_count: bool = False) -> DataFrame:
    """Failed rows by key (null: none), sorted by key, or by count and then key."""
    out = df.where(failed).groupBy(F.coalesce(_c(key).cast("string"), F.lit("none")).alias("key")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "key") if by_count else out.orderBy("key")


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return histogram(df, *keys).where("n > 1")


def elapsed_total(stages: DataFrame, key: str = "target_id", seconds: str = "elapsed_seconds") -> DataFrame:
    """Sum of the seconds that are recorded; null where none is."""
    return stages.groupBy(key).agg(F.sum(seconds).alias("total_seconds"))


def recorded_passes(df: DataFrame, key: str, passed: str) -> DataFrame:
    """Passes, and results that are recorded at all."""
    return df.groupBy(key).agg(F.count_if(F.col(passed)).alias("passed_count"), F.count(passed).alias("stage_count"))


def mutation_rates(df: DataFrame, key: str, built: Column, killed: Column) -> DataFrame:
    """attempted, build_succeeded, test_killed, survived, detection_rate (null where nothing was built)."""
    out = df.groupBy(key).agg(F.count("*").alias("attempted"), F.count_if(built).alias("build_succeeded"), F.count_if(built & killed).alias("test_killed"))
    return out.withColumns({"survived": F.col("build_succeeded") - F.col("test_killed"), "detection_rate": F.try_divide(F.col("test_killed").cast("double"), F.col("build_succeeded").cast("double"))})


def repeatable(df: DataFrame, key: str, run: str, order: str, value: str) -> DataFrame:
    """Whether all runs of a key list the same values in the same order."""
    lists = df.groupBy(key, run).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("string")).alias("seq"))
    return lists.groupBy(key).agg(F.count("*").alias("runs"), (F.count_distinct(F.sha2(F.to_json("seq"), 256)) == 1).alias("repeatable"))

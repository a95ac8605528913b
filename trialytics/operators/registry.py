"""Run and target registries: upsert, insert if absent, latest of each key, stale rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order (partial aggregation, no window)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest)).select(*df.columns)


def upsert(registry: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """The registry without the updated keys, and the last update of each."""
    return registry.join(updates.select(key).distinct(), key, "left_anti").unionByName(latest(updates, key, order))


def insert_if_absent(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return registry.unionByName(rows.join(registry.select(key), key, "left_anti"))


def stale(existing: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Existing rows that are readable, not enabled, and no longer expected."""
    return existing.where("readable and enabled = false").join(expected.select(key), key, "left_anti")

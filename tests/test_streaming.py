"""The registry of a stream: batches replace what is there, a repeated batch changes nothing, other buckets aren't touched."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import types as T

from trialytics.streaming import registry

SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("at", T.LongType())])


def add(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, runs, path, checkpoint):
    query = registry.maintain(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(runs), path, checkpoint, "run_id", "at", buckets=8)
    query.awaitTermination()
    return sorted(map(tuple, registry.current(spark, path, SCHEMA).collect()))


def test_registry_of_a_stream(spark, tmp_path):
    runs, path, checkpoint = (str(tmp_path / n) for n in ("runs", "registry", "checkpoint"))
    add(spark, [("a", "failed", 1), ("a", "passed", 2), ("b", "failed", 1), (None, "lost", 9)], runs)
    assert run(spark, runs, path, checkpoint) == [("a", "passed", 2), ("b", "failed", 1)]
    before = {d: sorted(os.listdir(tmp_path / "registry" / d)) for d in os.listdir(path) if d.startswith("_bucket")}
    shutil.copytree(checkpoint, tmp_path / "earlier")
    add(spark, [("b", "passed", 0), ("c", "skipped", 5)], runs)
    want = [("a", "passed", 2), ("b", "passed", 0), ("c", "skipped", 5)]
    assert run(spark, runs, path, checkpoint) == want
    assert run(spark, runs, path, checkpoint) == want
    # the second batch comes again, as after a lost checkpoint
    assert run(spark, runs, path, str(tmp_path / "earlier")) == want
    names = {r.run_id: r.b for r in spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string").withColumn("b", registry.bucket_of("run_id", 8)).collect()}
    own = f"_bucket={names['a']}"
    if names["a"] not in (names["b"], names["c"]):
        assert sorted(os.listdir(tmp_path / "registry" / own)) == before[own]


def test_registry_before_its_first_batch(spark, tmp_path):
    assert registry.current(spark, str(tmp_path / "none"), SCHEMA).count() == 0

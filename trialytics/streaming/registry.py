"""A run registry kept up to date from a stream of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trialytics.operators.registry import upsert
from trialytics.session import free, written

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def current(spark: SparkSession, registry_path: str, schema: T.StructType) -> DataFrame:
    """The registry's rows; none before the first batch."""
    return _rows(spark, registry_path, schema).drop(BUCKET)


def _rows(spark: SparkSession, registry_path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])
    # the folder, where it isn't there
    spark.createDataFrame([], whole).write.mode("ignore").partitionBy(BUCKET).parquet(registry_path)
    return spark.read.schema(whole).parquet(registry_path)


def maintain(runs: DataFrame, registry_path: str, checkpoint: str, key: str, order: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Upsert every micro-batch of runs into a registry that has one row a key: that of the greatest order, of runs that come together; a later batch replaces what is there.

    The registry lies in buckets by key. A batch reads and overwrites the buckets of its keys
    and no others. It is worked out before it is written, so that a batch that comes again, after
    its buckets were overwritten in part or in full, gives the same rows. Runs with a null key are left out.
    """
    schema = runs.schema

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.where(F.col(key).isNotNull())
        touched = [r[0] for r in named.select(bucket_of(key, buckets)).distinct().collect()]  # numbers, as many as buckets at most
        before = _rows(spark, registry_path, schema).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        after = written(spark, lambda: upsert(before, named, key, order), "registry")
        after.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(registry_path)
        free(after)

    return runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

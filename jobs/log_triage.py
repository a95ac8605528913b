"""Triage of logs as they arrive: size, digest, first error line and failure category of each.

    python jobs/log_triage.py --config jobs/log_triage.json --logs LOGS --output OUT --checkpoint DIR

LOGS is a folder of Parquet files to which files are added (or one file). The job reads it as a file stream:
the checkpoint knows the files of earlier runs, a run takes the new ones, files_per_batch at a
time, and ends. Every micro-batch has a number that a repeated attempt keeps, and is written to
partitions of that number, which a repeated attempt overwrites; so a run that was killed at any
place is mended by the next.

    OUT/records   a row a log, partitioned by batch and repository
    OUT/counts    logs, lines and characters by repository and category, partitioned by batch
    OUT/report    pass rates by repository with Wilson's interval, over all batches (CSV)
    OUT/owner     the stream whose checkpoint knows these batches; a run with another one is an error

The report is summed from counts, a few rows a batch; texts and records are read once. A log
that arrives again under its id replaces the earlier one in current(), not in the counts, which
say what arrived.

Config: names of the columns id, text and repository, files_per_batch, detail_chars (length of
an error line). Null texts are empty logs; a null or empty repository is 'unknown'; a log
without an error line has the category 'none' and passes. Further columns are ignored.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.functions.stats import wilson
from trialytics.functions.text import first_error_line, line_count
from trialytics.operators.classify import ERROR_LINES, build_category
from trialytics.operators.groups import group_key

log = logging.getLogger("log_triage")

DEFAULTS = {"id": "doc_id", "text": "text", "repository": "source", "files_per_batch": 100, "detail_chars": 500}


def triage(logs: DataFrame, config: dict) -> DataFrame:
    """id, repository, lines, chars, sha256, error_line, category of each log."""
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    line = F.nullif(first_error_line(text, ERROR_LINES, config["detail_chars"]), F.lit(""))
    found = logs.select(F.col(config["id"]).alias("id"), group_key(config["repository"]).alias("repository"), line_count(text).alias("lines"), F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("sha256"), line.alias("error_line"))
    return found.withColumn("category", F.when(F.col("error_line").isNull(), "none").otherwise(build_category(F.lower("error_line"))))


def record_schema(id_type: T.DataType) -> T.StructType:
    fields = [("id", id_type), ("lines", T.LongType()), ("chars", T.LongType()), ("sha256", T.StringType()), ("error_line", T.StringType()), ("category", T.StringType()), ("batch", T.LongType()), ("repository", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


COUNTS = "repository string, category string, logs long, lines long, chars long, batch long"


def _stream_path(spark: SparkSession, logs: str) -> str:
    """What a file stream reads logs by: a folder as it is; a single file, which streams don't take, as a pattern that matches it alone."""
    row = spark.read.parquet(logs).select("_metadata.file_path").head()
    name = logs.rstrip("/").rpartition("/")[2]
    return f"{logs.rstrip('/')[:-1]}[{name[-1]}]" if row and row[0].endswith(f"/{name}") else logs


def _claim(spark: SparkSession, output: str, stream: str) -> None:
    """Mark the output as the stream's own; an error if it is another's, whose batches would stand beside this one's under the same numbers."""
    path = f"{output}/owner"
    spark.createDataFrame([], "stream string").write.mode("ignore").parquet(path)  # the folder, where it isn't there
    held = {r[0] for r in spark.read.schema("stream string").parquet(path).collect()}
    if not held:
        spark.range(1).select(F.lit(stream).alias("stream")).coalesce(1).write.mode("append").parquet(path)
    elif held != {stream}:
        raise ValueError(f"{output} was written with another checkpoint; use that one, or a new output")


def _into_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite the partitions of df's rows and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, logs: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """One run over what is new. Returns the numbers of batches and logs that it took."""
    config = {**DEFAULTS, **(config or {})}
    schema = spark.read.parquet(logs).schema
    records = record_schema(schema[config["id"]].dataType)
    taken = {"batches": 0, "logs": 0}

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        _claim(own, output, own.sparkContext.getLocalProperty("sql.streaming.queryId"))
        seen = Observation("triage")
        rows = triage(batch, config).withColumn("batch", F.lit(number).cast("long")).observe(seen, F.count(F.lit(1)).alias("n"))
        # rebalance: files of an even size, large repositories in several
        _into_partitions(rows.hint("rebalance", "repository"), f"{output}/records", "batch", "repository")
        done = own.read.schema(records).parquet(f"{output}/records").where(F.col("batch") == number)
        counts = done.groupBy("batch", "repository", "category").agg(F.count("*").alias("logs"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))
        _into_partitions(counts.coalesce(1), f"{output}/counts", "batch")
        n = seen.get["n"]
        taken["batches"] += 1
        taken["logs"] += n
        log.info("batch %d: read %d logs of %s, wrote them to %s/records/batch=%d", number, n, logs, output, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_stream_path(spark, logs))
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if taken["batches"]:
        made = report(spark, output)
        made.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{output}/report")
    log.info("took %d logs in %d batches from %s; report in %s/report", taken["logs"], taken["batches"], logs, output)
    return taken


def report(spark: SparkSession, output: str) -> DataFrame:
    """repository, total, passed, failed, pass_rate and its interval, commonest failure; from the counts of all batches."""
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts").groupBy("repository", "category").agg(F.sum("logs").alias("logs"))
    failed = F.col("category") != "none"
    common = F.max_by(F.when(failed, F.col("category")), F.when(failed, F.struct("logs", "category"))).alias("commonest_failure")
    sums = counts.groupBy("repository").agg(F.sum("logs").alias("total"), F.coalesce(F.sum(F.when(~failed, F.col("logs"))), F.lit(0)).alias("passed"), F.coalesce(F.sum(F.when(failed, F.col("logs"))), F.lit(0)).alias("failed"), common)
    low, high = wilson("passed", "total")
    return sums.select("repository", "total", "passed", "failed", (F.col("passed") / F.col("total")).alias("pass_rate"), low.alias("wilson_95_low"), high.alias("wilson_95_high"), "commonest_failure").orderBy("repository")


def current(spark: SparkSession, output: str, id_type: T.DataType) -> DataFrame:
    """The last record of each id (of one batch, that of the greatest digest); rows without an id all stay."""
    rows = spark.read.schema(record_schema(id_type)).parquet(f"{output}/records")
    rest = [c for c in rows.columns if c != "id"]
    last = rows.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("batch", "sha256", "repository")).alias("r"))
    return last.select("id", "r.*").unionByName(rows.where("id is null"))


def main() -> None:
    parser = argparse.ArgumentParser(description="Triage of new logs.")
    for name in ("config", "logs", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=name != "config")
    parser.add_argument("--master")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = {}
    if args.config:
        with open(args.config, encoding="utf-8") as file:
            config = json.load(file)
    builder = SparkSession.builder.appName("log_triage").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    try:
        run(spark, args.logs, args.output, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

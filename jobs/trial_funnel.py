"""Daily funnel of trials from the stage results that are new.

    python jobs/trial_funnel.py --config jobs/trial_funnel.json --events EVENTS --output OUT --mark MARK

EVENTS is a table of stage results (event_id, ts, user_id, event_type, value) that grows; a
user's results of a day are a trial. The job keeps a high-water mark, the latest time it has
taken: a run looks for later results, and recounts the days from that of the mark, less
late_days, on. The filter on ts reaches the Parquet scan, so earlier days aren't read. Results
that come later than late_days are not taken; set late_days to the delay of the slowest source.
Without the mark's folder all days are recounted.

    OUT/funnel    by day and stage: results by status, those that reached the stage, pass rate
                  with Wilson's interval; partitioned by day
    OUT/trials    by day: trials, those without a failure, pass rate and interval; likewise
    MARK          a row a run: up_to; the greatest one counts

Days are overwritten as whole partitions and the mark is added last: a run that was killed, or
is repeated, gives the same days again. A result after the first failure of its trial counts as
skipped. The first failures are found by partial aggregation and joined to the results, so that
a user with a large share of all results needs no task of its own.

Config: stages in order (a result of another kind counts under the last one), limits of value
below which a result is failed, skipped or unknown, late_days. Results without a time are left
out; results without a user are one trial a day; without a value they are passed, as no limit
holds them. Results of equal time follow each other by event_id. An empty table writes nothing.
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

from trialytics.functions.stats import wilson
from trialytics.operators.funnel import skip_after_first

log = logging.getLogger("trial_funnel")

DEFAULTS = {"stages": ["view", "click", "cart", "purchase", "error", "other"], "failed_below": 20, "skipped_below": 30, "unknown_below": 35, "late_days": 1}
STATUSES = ("passed", "failed", "skipped", "unknown")
FUNNEL = "stage_order int, stage string, passed long, failed long, skipped long, unknown long, reached long, pass_rate double, wilson_95_low double, wilson_95_high double, day date"
TRIALS = "trials long, passed long, failed long, pass_rate double, wilson_95_low double, wilson_95_high double, day date"


def high_water(spark: SparkSession, mark: str, kind: str) -> str | None:
    """The latest time that earlier runs have taken, as text in the session's time zone; None before the first."""
    spark.createDataFrame([], f"up_to {kind}").write.mode("ignore").parquet(mark)  # the folder, where it isn't there
    return spark.read.schema(f"up_to {kind}").parquet(mark).agg(F.max("up_to").cast("string")).head()[0]


def judged(events: DataFrame, config: dict) -> DataFrame:
    """day, user_id, seq, stage, status of each result on its own."""
    stages = config["stages"]
    stage = F.when(F.col("event_type").isin(stages[:-1]), F.col("event_type")).otherwise(stages[-1])
    status = F.when(F.col("value") < config["failed_below"], "failed").when(F.col("value") < config["skipped_below"], "skipped").when(F.col("value") < config["unknown_below"], "unknown").otherwise("passed")
    return events.select(F.to_date("ts").alias("day"), "user_id", F.struct("ts", "event_id").alias("seq"), stage.alias("stage"), status.alias("status"))


def _with_rates(df: DataFrame, passed: str, total: str) -> DataFrame:
    low, high = wilson(passed, total)
    return df.withColumns({"pass_rate": F.try_divide(F.col(passed).cast("double"), F.col(total).cast("double")), "wilson_95_low": low, "wilson_95_high": high})


def funnel(results: DataFrame, config: dict) -> DataFrame:
    """A row for each day and stage, stages without results included; results: of judged()."""
    stages = config["stages"]
    after = skip_after_first(results, ("day", "user_id"), "seq", F.col("status") == "failed")
    results = after.select("day", "stage", F.when(F.col("skipped"), "skipped").otherwise(F.col("status")).alias("status"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    done = results.groupBy("day", "stage").agg(*counts)
    every = results.select("day").distinct().select("day", F.posexplode(F.array(*map(F.lit, stages))).alias("stage_order", "stage")).withColumn("stage_order", F.col("stage_order") + 1)
    filled = every.join(done, ["day", "stage"], "left").fillna(0, list(STATUSES)).withColumn("reached", F.col("passed") + F.col("failed"))
    return _with_rates(filled, "passed", "reached").select("day", "stage_order", "stage", *STATUSES, "reached", "pass_rate", "wilson_95_low", "wilson_95_high")


def trials(results: DataFrame) -> DataFrame:
    """A row a day: trials, and those without a failure; results: of judged()."""
    each = results.groupBy("day", "user_id").agg(F.max(F.col("status") == "failed").alias("lost"))
    days = each.groupBy("day").agg(F.count("*").alias("trials"), F.count_if(~F.col("lost")).alias("passed"), F.count_if("lost").alias("failed"))
    return _with_rates(days, "passed", "trials").select("day", "trials", "passed", "failed", "pass_rate", "wilson_95_low", "wilson_95_high")


def run(spark: SparkSession, events: str, output: str, mark: str, config: dict | None = None) -> dict[str, int]:
    """One run over what is new. Returns the numbers of new results, results read and days written."""
    config = {**DEFAULTS, **(config or {})}
    table = spark.read.parquet(events)
    kind = table.schema["ts"].dataType.simpleString()
    known = high_water(spark, mark, kind)
    time = lambda text: F.lit(text).cast(kind)
    if known is not None:
        table = table.where(F.col("ts") >= F.date_sub(time(known).cast("date"), config["late_days"]).cast(kind))
    is_new = F.lit(True) if known is None else F.col("ts") > time(known)
    new, read, latest = table.where("ts is not null").agg(F.count_if(is_new), F.count("*"), F.max("ts").cast("string")).head()
    if not new:
        log.info("nothing in %s after %s", events, known)
        return {"new": 0, "read": read, "days": 0}
    # results that arrive while the job runs wait for the next one
    results = judged(table.where(F.col("ts") <= time(latest)), config)
    seen = Observation("trial_funnel")
    for name, made in (("funnel", funnel(results, config)), ("trials", trials(results).observe(seen, F.count(F.lit(1)).alias("days"), F.sum("trials").alias("trials")))):
        made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/{name}")
    spark.range(1).select(time(latest).alias("up_to")).coalesce(1).write.mode("append").parquet(mark)
    log.info("read %d results of %s, %d of them after %s; wrote %d days with %d trials to %s; mark %s", read, events, new, known, seen.get["days"], seen.get["trials"], output, latest)
    return {"new": new, "read": read, "days": seen.get["days"]}


def main() -> None:
    parser = argparse.ArgumentParser(description="Daily funnel of new stage results.")
    for name in ("config", "events", "output", "mark"):
        parser.add_argument(f"--{name}", required=name != "config")
    parser.add_argument("--master")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = {}
    if args.config:
        with open(args.config, encoding="utf-8") as file:
            config = json.load(file)
    builder = SparkSession.builder.appName("trial_funnel").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    try:
        run(spark, args.events, args.output, args.mark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

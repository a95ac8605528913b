"""The jobs as queries: each runs twice into a new folder of the shared folder, over the whole tables, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import log_triage, trial_funnel
from trialytics.plans.queries import ERROR_SQL, LINE_SQL, RATES, build_sql, query, rounded, rounding
from trialytics.functions.stats import Z95
from trialytics.session import shared_root


def _new_folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(rf"""WITH s AS (SELECT doc_id AS id, coalesce(nullif(source, ''), 'unknown') AS repository, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, nullif(left(trim(regexp_replace({ERROR_SQL}, '[ \t\n\x0B\f\r]+', ' ', 'g')), 500), '') AS error_line FROM s)
SELECT id, repository, CAST({LINE_SQL.format("text")} AS BIGINT) AS lines, length(text) AS chars, sha256(text) AS sha256, error_line, CASE WHEN error_line IS NULL THEN 'none' ELSE {build_sql("lower(error_line)")} END AS category FROM e""")
def job1_log_triage(t):
    """What the triage of logs holds of each log after two runs over the same files."""
    folder = _new_folder(t.spark, "job1")
    logs = f"{t.folder}/documents.parquet"
    for _ in range(2):
        log_triage.run(t.spark, logs, f"{folder}/out", f"{folder}/checkpoint")
    return log_triage.current(t.spark, f"{folder}/out", t.documents.schema["doc_id"].dataType).select("id", "repository", "lines", "chars", "sha256", "error_line", "category")


Z2 = f"({Z95!r}e0 * {Z95!r}e0)"


@query(rounding(f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click', 'cart', 'purchase', 'error') THEN event_type ELSE 'other' END AS stage,
 CASE WHEN value < 20 THEN 'failed' WHEN value < 30 THEN 'skipped' WHEN value < 35 THEN 'unknown' ELSE 'passed' END AS own FROM events WHERE ts IS NOT NULL),
r AS (SELECT day, stage, CASE WHEN coalesce(max(CAST(own = 'failed' AS INTEGER)) OVER (PARTITION BY day, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' ELSE own END AS status FROM e),
d AS (SELECT day, unnest(['view', 'click', 'cart', 'purchase', 'error', 'other']) AS stage, CAST(unnest(range(1, 7)) AS INTEGER) AS stage_order FROM (SELECT DISTINCT day FROM e)),
c AS (SELECT day, stage_order, stage, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'unknown') AS unknown
 FROM d LEFT JOIN r USING (day, stage) GROUP BY ALL),
p AS (SELECT *, passed + failed AS reached, CAST(passed AS DOUBLE) / nullif(passed + failed, 0) AS p, CAST(passed + failed AS DOUBLE) AS n FROM c)
SELECT CAST(day AS VARCHAR) AS day, stage_order, stage, passed, failed, skipped, unknown, reached, p AS pass_rate,
 CASE WHEN n > 0 THEN greatest(0, (p + {Z2} / (2 * n)) / (1 + {Z2} / n) - {Z95!r}e0 * sqrt((p * (1 - p) + {Z2} / (4 * n)) / n) / (1 + {Z2} / n)) ELSE 0 END AS wilson_95_low,
 CASE WHEN n > 0 THEN least(1, (p + {Z2} / (2 * n)) / (1 + {Z2} / n) + {Z95!r}e0 * sqrt((p * (1 - p) + {Z2} / (4 * n)) / n) / (1 + {Z2} / n)) ELSE 0 END AS wilson_95_high FROM p""", *RATES))
def job2_trial_funnel(t):
    """The daily funnel after two runs over the same events."""
    folder = _new_folder(t.spark, "job2")
    for _ in range(2):
        trial_funnel.run(t.spark, f"{t.folder}/events.parquet", f"{folder}/out", f"{folder}/mark")
    done = t.spark.read.schema(trial_funnel.FUNNEL).parquet(f"{folder}/out/funnel")
    return rounded(done.withColumn("day", F.col("day").cast("string")), *RATES)

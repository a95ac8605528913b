"""Queries over the test tables, each with the SQL of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialytics.functions import coerce, fmt, stats, text
from trialytics.operators import catalog, classify, funnel, groups, lookup, quant, records, registry, validate
from trialytics.plans import batch
from trialytics.schemas import MODULE_FILES, stage_dimension
from trialytics.session import prepare
from trialytics.sources import files
from trialytics.udf import bundle, cpp, fence, jsontext, mdtable, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
EVENT_ORDER = ("view", "click", "cart", "purchase", "error")
Z2 = stats.Z95 * stats.Z95


def query(sql: str | None = None):
    """Register a function (tables) -> DataFrame under its name."""

    def register(made):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return made(Tables(spark, folder))

        run.__name__, run.__doc__ = made.__name__, made.__doc__
        QUERIES[made.__name__] = run
        if sql:
            ORACLES[made.__name__] = sql
        return made

    return register


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")


def rates_sql(source: str, keys: str) -> str:
    """Pass rates with Wilson's interval over a source with the columns of keys and ok."""
    z = repr(stats.Z95) + "e0"
    z2 = f"({z} * {z})"
    return f"""
SELECT {keys}{"," if keys else ""} total, passed, failed, CAST(passed AS DOUBLE) / total AS pass_rate,
  CASE WHEN total > 0 THEN greatest(0, (p + {z2} / (2 * n)) / (1 + {z2} / n) - {z} * sqrt((p * (1 - p) + {z2} / (4 * n)) / n) / (1 + {z2} / n)) ELSE 0 END AS wilson_95_low,
  CASE WHEN total > 0 THEN least(1, (p + {z2} / (2 * n)) / (1 + {z2} / n) + {z} * sqrt((p * (1 - p) + {z2} / (4 * n)) / n) / (1 + {z2} / n)) ELSE 0 END AS wilson_95_high
FROM (SELECT *, CAST(passed AS DOUBLE) / total AS p, CAST(total AS DOUBLE) AS n FROM (
  SELECT {keys}{"," if keys else ""} count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM ({source}) {"GROUP BY " + keys if keys else ""}))"""


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def rounding(sql: str, *names: str, digits: int = 9) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, {digits}) AS {n}' for n in names)}) FROM ({sql})"


RATES = ("pass_rate", "wilson_95_low", "wilson_95_high")
LABELLED = "SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id")


@query(rounding(rates_sql("SELECT o_orderpriority AS \"group\", CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS ok FROM orders", '"group"'), *RATES))
def group_wilson_orders(t):
    """Pass rates by one dimension; null outcomes count in the total only."""
    return rounded(groups.pass_rates(t.orders, "o_orderpriority", F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False)), *RATES)


@query(rounding(rates_sql(f"SELECT 'lang' AS dimension, coalesce(nullif(lang, ''), 'unknown') AS \"group\", quality = 1 AS ok FROM ({LABELLED}) UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), quality = 1 FROM ({LABELLED})", 'dimension, "group"'), *RATES))
def group_stats_multi_dim(t):
    return rounded(groups.pass_rates_by(labelled(t), ["lang", "source"], c("quality") == 1), *RATES)


@query(rounding(rates_sql("SELECT quality = 1 AS ok FROM labels", ""), *RATES))
def overall_summary(t):
    return rounded(groups.overall(t.labels, c("quality") == 1), *RATES)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))")
def grouping_sets_orders(t):
    return t.orders.groupingSets([["o_orderpriority"], ["o_orderstatus"]], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


EVENT_STAGES = "SELECT event_id, user_id, ts, event_type, value, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'cart' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 ELSE 6 END AS ord, CASE WHEN value < 20 THEN 'failed' WHEN value < 30 THEN 'skipped' WHEN value < 35 THEN 'unknown' ELSE 'passed' END AS status FROM events"


def event_stages(t: Tables) -> DataFrame:
    order = F.coalesce(*(F.when(c("event_type") == s, i) for i, s in enumerate(EVENT_ORDER, 1)), F.lit(6))
    return t.events.select("event_id", "user_id", "ts", "event_type", "value", order.alias("ord"), F.when(c("value") < 20, "failed").when(c("value") < 30, "skipped").when(c("value") < 35, "unknown").otherwise("passed").alias("status"))


@query(f"""WITH d AS (SELECT unnest(['view', 'click', 'cart', 'purchase', 'error', 'other']) AS stage, unnest(range(1, 7)) AS stage_order),
s AS ({EVENT_STAGES})
SELECT CAST(stage_order AS INTEGER) AS stage_order, stage, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
 count(*) FILTER (WHERE status = 'unknown') AS not_recorded_or_unknown, count(*) FILTER (WHERE status IN ('passed', 'failed')) AS reached
FROM d LEFT JOIN s ON s.event_type = d.stage GROUP BY ALL""")
def stage_funnel_events(t):
    return funnel.stage_funnel(event_stages(t).withColumnRenamed("event_type", "stage"), stage_dimension(t.spark, (*EVENT_ORDER, "other")))


@query(f"SELECT event_id, coalesce(max(CAST(status = 'failed' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM ({EVENT_STAGES})")
def skip_propagation(t):
    rows = event_stages(t).withColumn("seq", F.struct("ts", "event_id"))
    return funnel.propagate_skips(rows, "user_id", "seq", c("status") == "failed").select("event_id", "skipped")


@query(f"SELECT user_id, arg_min(event_type, (ord, ts, event_id)) AS first_stage FROM ({EVENT_STAGES}) WHERE status = 'failed' GROUP BY user_id")
def first_failure_stage(t):
    rows = event_stages(t).withColumn("seq", F.struct("ord", "ts", "event_id"))
    return funnel.first_failure(rows, "user_id", "seq", "event_type", c("status") == "failed")


@query("SELECT coalesce(event_type, 'none') AS key, count(*) AS n FROM events WHERE value < 20 GROUP BY 1")
def failure_counts_topk(t):
    return groups.failure_counts(t.events, "event_type", c("value") < 20, by_count=True)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def status_histogram(t):
    return groups.histogram(t.orders, "o_orderstatus", "o_orderpriority")


@query("SELECT count(*) FILTER (WHERE quality IS NULL) AS missing_quality, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE n_chars = 0) AS empty, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS good FROM documents LEFT JOIN labels USING (doc_id)")
def quality_counters(t):
    return groups.counters(t.documents.join(t.labels, "doc_id", "left"), missing_quality=c("quality").isNull(), toxic=c("toxic") == 1, empty=c("n_chars") == 0, good=(c("quality") == 1) & (c("toxic") == 0))


QUANT = ("pass_mean", "pass_median", "fail_mean", "fail_median", "point_biserial", "spearman")
LINE_SQL = "len(regexp_extract_all({0}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) + CAST(length({0}) > 0 AND NOT regexp_matches({0}, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]\\z') AS INTEGER)"


@query(rounding(f"""WITH b AS (SELECT quality = 1 AS ok, n_chars, {LINE_SQL.format("text")} AS loc FROM ({LABELLED})),
l AS (SELECT metric, CAST(value AS DOUBLE) AS value, CAST(ok AS INTEGER) AS o FROM (SELECT ok, 'n_chars' AS metric, n_chars AS value FROM b UNION ALL SELECT ok, 'loc', loc FROM b) WHERE value IS NOT NULL AND ok IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0e0 AS rk FROM l)
SELECT metric, count(*) AS n, avg(value) FILTER (WHERE o = 1) AS pass_mean, median(value) FILTER (WHERE o = 1) AS pass_median, avg(value) FILTER (WHERE o = 0) AS fail_mean, median(value) FILTER (WHERE o = 0) AS fail_median,
 CASE WHEN count(*) >= 3 AND var_pop(value) > 0 AND var_pop(o) > 0 THEN covar_pop(value, o) / (stddev_pop(value) * stddev_pop(o)) END AS point_biserial,
 CASE WHEN count(*) >= 3 AND var_pop(rk) > 0 AND var_pop(o) > 0 THEN corr(rk, o) END AS spearman FROM r GROUP BY metric""", *QUANT, digits=6))
def quant_by_outcome(t):
    rows = labelled(t).withColumn("loc", text.line_count("text"))
    return rounded(quant.metrics_by_outcome(rows, ["n_chars", "loc"], c("quality") == 1), *QUANT, digits=6)


@query(rounding(f"SELECT lang, CASE WHEN count(*) >= 3 AND var_pop(n_chars) > 0 AND var_pop(toxic) > 0 THEN covar_pop(n_chars, toxic) / (stddev_pop(n_chars) * stddev_pop(toxic)) END AS r FROM ({LABELLED}) WHERE n_chars IS NOT NULL AND toxic IS NOT NULL GROUP BY lang", "r"))
def point_biserial(t):
    return rounded(labelled(t).groupBy("lang").agg(stats.pearson("n_chars", "toxic").alias("r")), "r")


@query(rounding("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0e0 AS rx,
 rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0e0 AS ry FROM events)
SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS spearman FROM r GROUP BY event_type""", "spearman"))
def spearman_events(t):
    return rounded(quant.spearman(t.events, "value", "user_id", "event_type"), "spearman")


@query("SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0e0 AS avg_rank FROM lineitem")
def avg_rank(t):
    return quant.average_rank(t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity"), "l_quantity", "l_suppkey")


@query("""WITH g AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM labels),
s AS (SELECT *, unnest(range(greatest(0, (a + b) - (b + d)), least(a + b, a + c) + 1)) AS x FROM g),
p AS (SELECT *, exp(lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - a - b + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)) AS q FROM s)
SELECT a, b, c, d, round(least(1, sum(q) FILTER (WHERE q <= o + 1e-12)), 9) AS fisher_p FROM (SELECT *, max(q) FILTER (WHERE x = a) OVER () AS o FROM p) WHERE a + b > 0 AND c + d > 0 GROUP BY a, b, c, d""")
def fisher_quality_toxic(t):
    return rounded(quant.two_by_two(t.labels, c("quality").cast("string"), "1", "0", c("toxic") == 1), "fisher_p")


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_run_per_key(t):
    rows = t.orders.withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    return registry.latest(rows, "o_custkey", "seq").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT CAST(s_suppkey AS INTEGER), s_name FROM supplier WHERE CAST(s_suppkey AS INTEGER) NOT IN (SELECT n_nationkey FROM nation)")
def insert_if_absent(t):
    have = t.nation.select(c("n_nationkey").alias("key"), c("n_name").alias("name"))
    return registry.insert_if_absent(have, t.supplier.select(c("s_suppkey").cast("int").alias("key"), c("s_name").alias("name")), "key")


@query("""WITH u AS (SELECT o_custkey AS key, o_orderstatus AS status, o_orderkey AS seq FROM orders), b AS (SELECT c_custkey AS key, c_mktsegment AS status, CAST(0 AS BIGINT) AS seq FROM customer)
SELECT * FROM b WHERE key NOT IN (SELECT key FROM u WHERE key IS NOT NULL) UNION ALL SELECT key, arg_max(status, seq), max(seq) FROM u GROUP BY key""")
def registry_upsert(t):
    have = t.customer.select(c("c_custkey").alias("key"), c("c_mktsegment").alias("status"), F.lit(0).cast("bigint").alias("seq"))
    new = t.orders.select(c("o_custkey").alias("key"), c("o_orderstatus").alias("status"), c("o_orderkey").alias("seq"))
    return registry.upsert(have, new, "key", "seq")


@query("""SELECT c_custkey, c_name, f.o_orderkey, f.o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1) f ON c_custkey = f.o_custkey""")
def first_match_lookup(t):
    right = t.orders.withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    return lookup.first_match(t.customer.select("c_custkey", "c_name"), right, "c_custkey", ["o_custkey"], "seq", ["o_orderkey", "o_orderstatus"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_filter(t):
    return lookup.semi(t.documents.select("doc_id", "lang"), t.labels.where("toxic = 1"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE NOT contains(coalesce(text, ''), 'icens') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_excluded(t):
    kept, _ = catalog.split_excluded(t.documents, "text", "icens")
    return lookup.anti(kept.select("doc_id", "lang"), t.labels, "doc_id")


UNIQUE = """WITH a AS (SELECT p_partkey AS id, regexp_replace(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x' END), '[^a-z0-9]', '', 'g') AS k FROM part),
b AS (SELECT p_partkey AS v, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
e AS (SELECT id, count(*) AS n, min(v) AS v FROM a JOIN b USING (k) GROUP BY id),
w AS (SELECT id, count(*) AS n, min(v) AS v FROM a JOIN b ON (contains(a.k, b.k) OR contains(b.k, a.k)) WHERE id NOT IN (SELECT id FROM e WHERE n = 1) GROUP BY id)
SELECT a.id, CASE WHEN e.n = 1 THEN e.v WHEN w.n = 1 THEN w.v END AS v FROM a LEFT JOIN e USING (id) LEFT JOIN w USING (id)"""


@query(UNIQUE)
def unique_match_join(t):
    left = t.part.select(c("p_partkey").alias("id"), F.concat("p_name", F.when(c("p_partkey") % 3 == 0, "").otherwise("x")).alias("name"))
    right = t.part.select(c("p_partkey").alias("v"), c("p_name").alias("other"))
    return lookup.unique_match(left, right, text.squash("name"), text.squash("other"), "id", "v")


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS key, CAST(g AS INTEGER) AS v FROM orders, unnest(range(1, CAST(o_orderkey % 4 AS BIGINT) + 2)) u(g)), b AS (SELECT DISTINCT l_orderkey AS key, l_linenumber AS v FROM lineitem)
SELECT key, bool_and(a.v IS NOT NULL AND b.v IS NOT NULL) AS same FROM a FULL JOIN b USING (key, v) GROUP BY key""")
def set_equality(t):
    left = t.orders.select(c("o_orderkey").alias("key"), F.explode(F.sequence(F.lit(1), (c("o_orderkey") % 4).cast("int") + 1)).alias("v"))
    return lookup.same_sets(left, t.lineitem.select(c("l_orderkey").alias("key"), "l_linenumber"), "key", "v", "l_linenumber")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(t):
    return groups.duplicates(t.documents, "text")


@query("""WITH r AS (SELECT d.doc_id, n_chars, quality, toxic, lang FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, 1 AS rule_no, 'unlabelled' AS message FROM r WHERE quality IS NULL UNION ALL SELECT doc_id, 2, 'toxic but good' FROM r WHERE toxic = 1 AND quality = 1 UNION ALL SELECT doc_id, 3, 'very short' FROM r WHERE n_chars < 60""")
def validation_rules(t):
    rules = [("unlabelled", c("quality").isNull()), ("toxic but good", (c("toxic") == 1) & (c("quality") == 1)), ("very short", c("n_chars") < 60)]
    return validate.violations(t.documents.join(t.labels, "doc_id", "left"), "doc_id", rules)


@query("SELECT conv_id, arg_min(nullif(role, 'user'), turn) FILTER (WHERE nullif(role, 'user') IS NOT NULL) AS role, arg_min(text, turn) FILTER (WHERE nullif(text, '') IS NOT NULL) AS text FROM conversations GROUP BY conv_id")
def merge_first_nonempty(t):
    rows = t.conversations.withColumn("role", F.when(c("role") != "user", c("role")).otherwise(""))
    return catalog.fold_first(rows, "conv_id", "turn", ["role", "text"])


@query("""WITH RECURSIVE o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> ''),
f(conv_id, i, notes) AS (SELECT conv_id, i, role FROM o WHERE i = 1 UNION ALL SELECT f.conv_id, o.i, CASE WHEN contains(f.notes, o.role) THEN f.notes ELSE f.notes || '; ' || o.role END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, arg_max(notes, i) AS role FROM f GROUP BY conv_id""")
def merge_notes(t):
    return catalog.fold_notes(t.conversations, "conv_id", "turn", "role")


@query("""WITH w AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FAILED' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN '' WHEN 6 THEN 'Success ' ELSE NULL END AS s FROM orders)
SELECT o_orderkey, CASE WHEN lower(trim(s)) IN ('true','yes','1','pass','passed','success') THEN true WHEN lower(trim(s)) IN ('false','no','0','fail','failed','error') THEN false END AS b,
CASE WHEN lower(trim(s)) IN ('pass','passed','success','true') THEN 'passed' WHEN lower(trim(s)) IN ('fail','failed','failure','error','false') THEN 'failed' END AS status FROM w""")
def coerce_bool(t):
    words = F.element_at(F.array(*map(F.lit, (" Yes", "FAILED", "1", "0", "maybe", "", "Success ", None))), (c("o_orderkey") % 8).cast("int") + 1)
    return t.orders.select("o_orderkey", coerce.coerce_bool(words).alias("b"), coerce.normalize_status(words).alias("status"))


@query("""WITH w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_id || '.0' WHEN 2 THEN '1_0' || event_id WHEN 3 THEN 'x' ELSE CAST(value AS VARCHAR) END AS s, value FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(s), '[+-]?\\d+(_\\d+)*') THEN CAST(replace(trim(s), '_', '') AS BIGINT) END AS i, CASE WHEN s = 'x' OR contains(s, '_') THEN NULL ELSE TRY_CAST(trim(s) AS DOUBLE) END AS f, CAST(trunc(value) AS BIGINT) AS whole FROM w""")
def coerce_num(t):
    e = c("event_id").cast("string")
    words = F.element_at(F.array(F.concat(F.lit(" "), e, F.lit(" ")), F.concat(e, F.lit(".0")), F.concat(F.lit("1_0"), e), F.lit("x"), c("value").cast("string")), (c("event_id") % 5).cast("int") + 1)
    return t.events.select("event_id", coerce.coerce_int(words).alias("i"), coerce.coerce_float(words).alias("f"), coerce.truncate_int("value").alias("whole"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 1 THEN c_name END, ''), 'none') AS v FROM customer")
def first_nonempty(t):
    return t.customer.select("c_custkey", coerce.first_nonempty(F.when(c("c_custkey") % 3 == 0, c("c_mktsegment")).otherwise(""), F.when(c("c_custkey") % 3 == 1, c("c_name")), F.lit("none")).alias("v"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS v, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.z'), 'default') AS z FROM events""")
def nested_get_props(t):
    doc = F.try_parse_json(F.when(c("event_id") % 3 == 0, F.concat(F.lit('{"a": null, '), F.substring("props", 2, 1 << 30))).otherwise(c("props")))
    rows = t.events.select("event_id", doc.alias("d"))
    return rows.select("event_id", coerce.variant_path("d", "a", "k").alias("v"), coerce.variant_path("d", "k").alias("k"), coerce.nested_default("d", "z", F.lit("default")).alias("z"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 5 = 0 THEN false WHEN o_orderstatus = 'F' THEN true WHEN o_orderpriority = '1-URGENT' THEN false END AS overall_pass,
CASE WHEN o_orderkey % 11 = 0 THEN 'not_recorded' WHEN o_orderkey % 3 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'passed' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'unknown' END AS stage,
CASE WHEN o_orderkey % 7 = 0 OR (o_orderkey % 5 <> 0 AND o_orderstatus = 'F') THEN 'PASS' ELSE 'FAIL' END AS result FROM orders""")
def overall_ladder(t):
    k = c("o_orderkey")
    verdict = coerce.overall_ladder(F.when(k % 7 == 0, True), F.when(k % 5 == 0, False), F.lit(None).cast("boolean"), F.when(c("o_orderstatus") == "F", "passed"), c("o_orderpriority") == "1-URGENT")
    stage = coerce.stage_status(k % 3 == 0, F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False), F.lit("?"), k % 11 != 0)
    return t.orders.select("o_orderkey", verdict.alias("overall_pass"), stage.alias("stage"), coerce.result_label(verdict).alias("result"))


@query(f"SELECT doc_id, CAST({LINE_SQL.format('text')} AS BIGINT) AS loc, length(text) AS chars FROM documents")
def loc_chars(t):
    return t.documents.select("doc_id", text.line_count("text").alias("loc"), F.length("text").cast("bigint").alias("chars"))


@query(f"SELECT source, sum({LINE_SQL.format('text')})::BIGINT AS loc, sum(length(text))::BIGINT AS chars, round(sum({LINE_SQL.format('text')}) / CAST(nullif(sum(length(text)), 0) AS DOUBLE), 9) AS ratio FROM documents GROUP BY source")
def loc_by_source(t):
    sized = files.sizes(t.documents.withColumnRenamed("text", "value"), "source")
    return sized.withColumn("ratio", F.round(fmt.ratio("loc", "chars"), 9))


@query(r"""SELECT doc_id, left(trim(regexp_replace(coalesce(nullif(regexp_extract(text, '(?im)^.*(?:licensed under).*$'), ''), nullif(regexp_extract(text, '(?im)^.*(?:token|@).*$'), '')), '[ \t\n\x0B\f\r]+', ' ', 'g')), 500) AS line FROM documents""")
def first_error_line(t):
    return t.documents.select("doc_id", text.first_error_line("text", ["licensed under", "token|@"]).alias("line"))


def build_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{k}'" for k, p in classify.BUILD_RULES) + " ELSE 'build_failure_other' END"


ERROR_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?im)^.*(?:{p}).*$'), '')" for p in classify.ERROR_LINES) + ")"


@query(rf"""WITH s AS (SELECT doc_id, text, n_chars, quality, toxic, nullif(left(trim(regexp_replace({ERROR_SQL}, '[ \t\n\x0B\f\r]+', ' ', 'g')), 500), '') AS e FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN NULL WHEN n_chars > 20000 THEN 'design_generation' WHEN contains(lower(text), 'licen') THEN 'configure' WHEN doc_id % 3 = 0 THEN 'build' WHEN doc_id % 3 = 1 THEN 'direct_test' ELSE 'unknown' END AS stage,
CASE WHEN quality = 1 AND toxic = 0 THEN 'none' WHEN n_chars > 20000 THEN 'timeout_or_hang' WHEN contains(lower(text), 'licen') THEN 'configure_failure' WHEN doc_id % 3 = 0 THEN {build_sql("lower(coalesce(e, left(text, 5000)))")}
 WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'timeout_or_hang' ELSE 'direct_test_failure' END ELSE 'unknown_failure' END AS category
FROM s""")
def failure_classifier(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    none, doc = F.lit(None).cast("string"), c("doc_id")
    stages = ("configure", "build", "direct_test", "full_test")
    row = {"overall_pass": (c("quality") == 1) & (c("toxic") == 0), "design_reason": none, "code_reason": none, "failure_present": F.lit(False), "failure_stage": none, "failure_message": none, "detail": none}
    states = {"configure": F.lower("text").contains("licen"), "build": doc % 3 == 0, "direct_test": doc % 3 == 1, "full_test": F.lit(False)}
    for s in ("design_generation", *stages):
        row |= {f"{s}_status": F.when(states.get(s, F.lit(False)), "failed").otherwise("passed"), f"{s}_timed_out": (c("n_chars") > 20000) & F.lit(s == "design_generation"), f"{s}_exit": F.when(doc % 2 == 0, 124).otherwise(1), f"{s}_ran": F.lit(None).cast("int")}
    return rows.select("doc_id", classify.classify(row, ("design_generation", *stages), c("text")).alias("r")).select("doc_id", "r.stage", "r.category")


@query(r"""SELECT page_id, list_last(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS last_href, TRY_CAST(nullif(regexp_extract(html, '\d+'), '') AS BIGINT) AS first_number FROM pages""")
def last_match_counts(t):
    return t.pages.select("page_id", text.last_match("html", 'href="([^"]*)"').alias("last_href"), text.first_int("html").alias("first_number"))


@query("SELECT o_orderkey, CAST(10 + o_orderkey % 90 AS BIGINT) AS ran, CAST(10 + o_orderkey % 90 - o_orderkey % 7 AS BIGINT) AS passed, CAST(o_orderkey % 7 AS BIGINT) AS failed, CAST(o_orderkey % 50 AS BIGINT) AS g_ran, CAST(o_orderkey % 13 AS BIGINT) AS g_failed FROM orders")
def ctest_counts(t):
    k = c("o_orderkey")
    log = F.concat((k % 100).cast("string"), F.lit("% tests passed, "), (k % 7).cast("string"), F.lit(" tests failed out of "), (10 + k % 90).cast("string"))
    glog = F.concat(F.lit("[==========] 99 tests from 1 test suite ran.\n[==========] "), (k % 50).cast("string"), F.lit(" tests from 3 test suites ran.\n"), F.when(k % 13 > 0, F.concat(F.lit("[  FAILED  ] "), (k % 13).cast("string"), F.lit(" tests, listed below:"))).otherwise(""))
    rows = t.orders.select("o_orderkey", text.ctest_counts(log).alias("t"), text.gtest_counts(glog).alias("g"))
    return rows.select("o_orderkey", "t.ran", "t.passed", "t.failed", c("g.ran").alias("g_ran"), c("g.failed").alias("g_failed"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(replace(lower(trim(url)), '::', '-'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'target') AS slug, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS squashed FROM pages")
def slugs(t):
    return t.pages.select("page_id", text.slug("url").alias("slug"), text.squash("url").alias("squashed"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(n, '-[0-9]{3,}$') THEN regexp_extract(n, '^(.*)-[0-9]+$', 1) || '-' || lpad(CAST(CAST(regexp_extract(n, '([0-9]+)$', 1) AS BIGINT) + 1 AS VARCHAR), CAST(greatest(3, length(CAST(CAST(regexp_extract(n, '([0-9]+)$', 1) AS BIGINT) + 1 AS VARCHAR))) AS INTEGER), '0') ELSE n || '-002' END AS bumped FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'run-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') ELSE 'run' END AS n FROM part)")
def bumped_identifiers(t):
    return t.part.select("p_partkey", text.bump_identifier(F.when(c("p_partkey") % 2 == 0, F.format_string("run-%03d", "p_partkey")).otherwise("run")).alias("bumped"))


@query()
def source_paths(t):
    return t.pages.select("page_id", text.source_paths(F.concat(c("url"), F.lit(" src/a/b.cpp, include/x.hpp "), c("html"))).alias("paths"))


@query()
def backref_counts(t):
    k = (c("o_orderkey") % 60).cast("string")
    return t.orders.select("o_orderkey", text.repeated_count(F.concat(F.lit("CTest "), k, F.lit("/63, then "), k, F.lit("/"), k)).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS i, array_to_string(list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: trim(x)), '~') AS cells FROM l WHERE starts_with(trim(line), '|')""")
def md_row_split(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", "i", F.array_join(text.markdown_cells("line"), "~").alias("cells")).where("cells is not null")


def nation_report(t: Tables) -> DataFrame:
    line = F.concat(F.lit("| "), c("n_nationkey").cast("string"), F.lit(" | `"), c("n_name"), F.lit("` |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda s: s["l"]), "\n")
    return t.nation.groupBy(c("n_regionkey").cast("string").alias("path")).agg(F.concat(F.lit("text\n\n| No | Target |\n|---|:---:|\n"), body, F.lit("\n\nmore | text\n")).alias("text"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS path, 1 AS table_no, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row_no, 'No~Target' AS header, CAST(n_nationkey AS VARCHAR) || '~`' || n_name || '`' AS cells FROM nation")
def md_tables(t):
    rows = catalog.table_rows(nation_report(t), "path", "text")
    return rows.select("path", "table_no", "row_no", F.array_join("header", "~").alias("header"), F.array_join("cells", "~").alias("cells"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS path, 1 AS table_no, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row_no, CAST(n_nationkey AS VARCHAR) || '~`' || n_name || '`' AS cells FROM nation")
def md_tables_udtf(t):
    t.spark.udtf.register("markdown_tables", mdtable.MarkdownTables)
    nation_report(t).createOrReplaceTempView("nation_reports")
    return t.spark.sql("SELECT path, table_no, row_no, array_join(cells, '~') AS cells FROM nation_reports, LATERAL markdown_tables(text)")


@query("SELECT lower(n_name) AS key, n_name AS target, CAST(n_nationkey AS VARCHAR) AS number, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS target_id FROM nation")
def catalog_from_reports(t):
    return batch.catalog_records(nation_report(t), {"target": ["target", "対象"], "number": ["no"]})


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_docs(t):
    return t.documents.select("doc_id", fmt.sha256("text").alias("digest"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'crlf_to_lf_normalized' ELSE 'mismatch' END AS state FROM documents WHERE contains(text, chr(10))")
def hash_verify(t):
    rows = t.documents.where(c("text").contains("\n"))
    given = F.when(c("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(c("text"))
    return rows.select("doc_id", fmt.hash_check(given, F.when(c("doc_id") % 3 == 2, "none").otherwise(fmt.sha256("text"))).alias("state"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderkey % 4 = 1 THEN 'mismatch' ELSE 'match' END AS state FROM orders")
def hash_compare(t):
    expected = t.orders.select(c("o_orderkey").alias("key"), fmt.sha256("o_orderstatus").alias("h"))
    actual = t.orders.where("o_orderkey % 4 <> 0").select(c("o_orderkey").alias("key"), fmt.sha256(F.when(c("o_orderkey") % 4 == 1, "?").otherwise(c("o_orderstatus"))).alias("h"))
    return lookup.verify(expected, actual, "key", "h")


@query(r"SELECT doc_id, sha256(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS bare, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), 'The '))) AS INTEGER) AS n FROM documents")
def text_normalize_lines(t):
    crlf = text.renewline("text", "\r\n")
    return t.documents.select("doc_id", fmt.sha256(text.normalized_text(crlf)).alias("bare"), F.size(F.filter(F.split(text.unify_newlines(crlf), "\n"), lambda s: F.ltrim(s).startswith("The "))).alias("n"))


@query()
def brace_match(t):
    opening = F.instr("html", "{") - 1
    return t.pages.select("page_id", opening.alias("opening"), cpp.matching_brace_udf("html", opening).alias("closing"))


@query()
def class_spans(t):
    source = F.concat(F.lit("struct P { int a; };\nclass X : P { void f() { if (a) { a = '}'; } } };\n"), c("p_name"))
    rows = t.part.select("p_partkey", cpp.class_span_udf(source, F.when(c("p_partkey") % 2 == 0, "X").otherwise("Y")).alias("s"))
    return rows.select("p_partkey", "s.start", "s.end", "s.error")


@query()
def strip_bodies(t):
    return t.pages.select("page_id", fmt.sha256(cpp.without_bodies_udf(F.concat(F.lit("int f() const { return 1; } if (x) { y(); }\n"), "html"))).alias("digest"))


@query()
def similarity_pairs(t):
    a = t.documents.select("doc_id", "lang", "text")
    b = a.select((c("doc_id") - 1).alias("doc_id"), c("text").alias("other"))
    rows = a.join(b, "doc_id")
    return rows.select("doc_id", *(v.alias(k) for k, v in similarity.compare(c("text"), c("other")).items()))


#: Wrapped texts, in Spark and in SQL: bare, fenced, fenced with blanks around, unclosed, without a line end before the closing fence, with another info string, with line ends of two letters, nested, empty, in another language.
WRAPS = (("", ""), ("```cpp\n", "\n```"), ("\n```\n", "\n```\n"), ("```cpp\n", ""), ("```cpp\n", "```"), ("```c pp\n", "\n```"), ("```CPP \r\nint\r\n", "\r\n``` "), ("```cc\n```\n", "\n```\n```"), ("```\n \n```", ""), ("```java\n", "\n```"), ("x\n```cpp\n", "\n```"))


def wrapped(t: Tables) -> DataFrame:
    ends = [F.get(F.array(*(F.lit(w[i]) for w in WRAPS)), (c("p_partkey") % len(WRAPS)).cast("int")) for i in (0, 1)]
    bare = F.when(c("p_partkey") % len(WRAPS) == 8, "").otherwise(c("p_name"))
    return t.part.select("p_partkey", F.concat(ends[0], bare, ends[1]).alias("w"))


def _sql_text(x: str) -> str:
    return " || ".join(f"chr({ord(ch)})" if ch in "\n\r" else f"'{ch}'" for ch in x) or "''"


WRAPPED = "SELECT p_partkey, CASE p_partkey % " + str(len(WRAPS)) + " " + " ".join(f"WHEN {i} THEN {_sql_text(a)} || {chr(39) * 2 if i == 8 else 'p_name'} || {_sql_text(b)}" for i, (a, b) in enumerate(WRAPS)) + " END AS w FROM part"


@query(rf"""SELECT p_partkey, CASE WHEN regexp_full_match(w, '\s*```[A-Za-z0-9_+.-]*\s*\n(.*)\n```\s*', 's') THEN regexp_extract(w, '^\s*```[A-Za-z0-9_+.-]*\s*\n(.*)\n```\s*$', 1, 's') ELSE w END AS body FROM ({WRAPPED})""")
def fence_strip(t):
    return wrapped(t).select("p_partkey", text.strip_fence("w").alias("body"))


@query(rf"""WITH o AS (SELECT *, regexp_full_match(w, '\s*```([A-Za-z0-9_+-]*)[ \t]*\r?\n(.*)\r?\n```[ \t]*\s*', 's') AS outer_, regexp_extract(w, '^\s*```([A-Za-z0-9_+-]*)[ \t]*\r?\n(.*)\r?\n```[ \t]*\s*$', 1, 's') AS lang, regexp_extract(w, '^\s*```([A-Za-z0-9_+-]*)[ \t]*\r?\n(.*)\r?\n```[ \t]*\s*$', 2, 's') AS body FROM ({WRAPPED})),
e AS (SELECT *, CASE WHEN NOT outer_ AND regexp_matches(w, '(?m)^[ \t]*```[A-Za-z0-9_+-]*[ \t]*$') THEN 'unmatched_fence' WHEN outer_ AND lower(lang) NOT IN ('', 'cpp', 'c++', 'cc', 'cxx') THEN 'disallowed_language' WHEN outer_ AND NOT regexp_matches(body, '\S') THEN 'empty_body' WHEN outer_ AND regexp_matches(body, '(?m)^[ \t]*```[A-Za-z0-9_+-]*[ \t]*$') THEN 'nested_fence' END AS error FROM o),
n AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN outer_ THEN body ELSE w END END AS normalized, outer_ AND error IS NULL AS applied FROM e)
SELECT p_partkey, normalized, error, applied, CASE WHEN applied THEN 'outer_markdown_fence' ELSE 'none' END AS type, CASE WHEN applied THEN lower(lang) END AS language, NOT applied AND error IS NULL AS strict_format_pass, sha256(w) AS raw_sha256, sha256(normalized) AS normalized_sha256 FROM n""")
def fence_normalize(t):
    return wrapped(t).select("p_partkey", fence.normalize("w").alias("r")).select("p_partkey", "r.*")


@query("SELECT lang AS key, count(*) AS attempted, count(*) FILTER (WHERE quality = 1) AS build_succeeded, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS test_killed, count(*) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS survived, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / CAST(nullif(count(*) FILTER (WHERE quality = 1), 0) AS DOUBLE), 9) AS detection_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def mutation_rates(t):
    return rounded(groups.mutation_rates(labelled(t), "lang", c("quality") == 1, c("toxic") == 1), "detection_rate").withColumnRenamed("lang", "key")


@query("WITH s AS (SELECT user_id, event_type, list(CAST(value > 50 AS VARCHAR) ORDER BY ts, event_id) AS seq FROM events GROUP BY ALL) SELECT user_id, count(*) AS runs, count(DISTINCT seq) = 1 AS repeatable FROM s GROUP BY user_id")
def repeatability(t):
    rows = t.events.select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), (c("value") > 50).alias("v"))
    return groups.repeatable(rows, "user_id", "event_type", "seq", "v")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%.1f', l_discount * 100) || '%' AS pct, printf('%.3f', l_extendedprice) AS num, CASE WHEN l_quantity * 3 < 60 THEN printf('%.2f', l_quantity * 3) || '秒' ELSE CAST(CAST(floor(l_quantity * 3 / 60) AS BIGINT) AS VARCHAR) || '分' || printf('%.2f', l_quantity * 3 - floor(l_quantity * 3 / 60) * 60) || '秒' END AS dur FROM lineitem")
def format_numbers(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fmt.percent("l_discount").alias("pct"), fmt.number("l_extendedprice").alias("num"), fmt.duration(c("l_quantity") * 3).alias("dur"))


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{s}') AS {s}_value, max(event_id) FILTER (WHERE event_type = '{s}') AS {s}_event_id" for s in EVENT_ORDER) + " FROM events GROUP BY user_id")
def flatten_pivot(t):
    return records.flatten_stages(t.events.withColumnRenamed("event_type", "stage"), "user_id", EVENT_ORDER, ("value", "event_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'a.h~b.cc' ELSE 'a.h' END AS paths, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS content, o_orderkey % 3 = 1 AS expected FROM orders""")
def json_files_map(t):
    k, s = c("o_orderkey") % 3, c("o_orderstatus")
    two = F.concat(F.lit('{"files": [{"path": "a.h", "content": "old"}, {"path": "b.cc", "content": "x"}, {"path": "a.h", "content": "'), s, F.lit('"}]}'))
    one = F.concat(F.lit('{"files": [{"path": "a.h", "content": "'), s, F.lit('"}]}'))
    last = coerce.file_map(F.when(k == 0, "{nope").when(k == 1, two).otherwise(one), MODULE_FILES)
    rows = t.orders.select("o_orderkey", last.alias("m"))
    names = F.array_sort(F.map_keys("m"))
    return rows.select("o_orderkey", F.array_join(names, "~").alias("paths"), F.try_element_at(c("m"), F.lit("a.h")).alias("content"), F.coalesce(names == F.array(F.lit("a.h"), F.lit("b.cc")), F.lit(False)).alias("expected"))


@query()
def json_errors(t):
    broken = F.when(c("event_id") % 2 == 0, c("props")).otherwise(F.substring("props", 1, 6))
    return t.events.select("event_id", jsontext.error_context(broken).alias("e")).select("event_id", "e.line", "e.column", "e.message")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 2 = 0")
def recursive_entry(t):
    doc = F.concat(F.lit('{"runs": [{"id": "zz"}, {"batch": [{"target_id": "e'), c("event_id").cast("string"), F.lit('", "props": '), c("props"), F.lit("}]}]}"))
    found = jsontext.find_entry_udf(doc, F.when(c("event_id") % 2 == 0, F.concat(F.lit("e"), c("event_id").cast("string"))).otherwise("none"))
    return t.events.select("event_id", F.get_json_object(found, "$.props.k").alias("k"), found.alias("f")).where("f is not null").drop("f")


@query("SELECT n_regionkey AS key, string_agg('===== FILE: ' || n_name || ' =====' || chr(10) || n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS bundle FROM nation GROUP BY 1")
def design_bundle(t):
    return bundle.bundle(t.nation, "n_regionkey", "n_nationkey", c("n_name"), c("n_name")).withColumnRenamed("n_regionkey", "key")


@query("SELECT p_partkey, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '&lt;&amp;&quot;&apos;' AS xml, CASE WHEN p_partkey % 5 = 0 THEN '—' ELSE p_name || '\\|b c' END AS cell FROM part")
def escapes(t):
    return t.part.select("p_partkey", fmt.xml_escape(F.concat(c("p_name"), F.lit("<&\"'"))).alias("xml"), fmt.markdown_cell(F.when(c("p_partkey") % 5 == 0, "").otherwise(F.concat(c("p_name"), F.lit("|b\nc")))).alias("cell"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderstatus' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN '~' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'o_orderpriority' ELSE '' END AS missing, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AS complete FROM orders")
def readiness(t):
    k = c("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 2 != 0, c("o_orderstatus")).alias("o_orderstatus"), F.when(k % 3 != 0, c("o_orderpriority")).otherwise("").alias("o_orderpriority"))
    out = batch.readiness(rows, ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", F.array_join("metadata_missing", "~").alias("missing"), c("metadata_complete").alias("complete"))


@query("SELECT user_id, sum(CASE WHEN value >= 20 THEN value END) IS NULL AS none, round(sum(CASE WHEN value >= 20 THEN value END), 6) AS total_seconds, count(*) FILTER (WHERE value > 50) AS passed_count, count(*) FILTER (WHERE value >= 20) AS stage_count FROM events GROUP BY user_id")
def elapsed_and_passes(t):
    rows = t.events.select("user_id", F.when(c("value") >= 20, c("value")).alias("s"), F.when(c("value") >= 20, c("value") > 50).alias("p"))
    both = groups.elapsed_total(rows, "user_id", "s").join(groups.recorded_passes(rows, "user_id", "p"), "user_id")
    return both.select("user_id", c("total_seconds").isNull().alias("none"), F.round("total_seconds", 6).alias("total_seconds"), "passed_count", "stage_count")


@query("SELECT user_id AS key, bool_and(value >= 1) AND count(*) >= 4 AS overall_pass FROM events GROUP BY user_id")
def overall_passes(t):
    yes = F.lit(True)
    return funnel.overall_passes(t.events, "user_id", c("value") >= 1, F.lit(None).cast("string"), yes, yes).withColumnRenamed("user_id", "key")


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS ok FROM orders")
def stage_pass_rule(t):
    k = c("o_orderkey")
    n = F.lit(3)
    ok = funnel.stage_passes(F.when(k % 5 == 0, 0).when(k % 5 == 1, 1), F.when(k % 5 != 2, n), n, F.lit(0), n, F.when(k % 5 == 3, True))
    return t.orders.select("o_orderkey", (ok & (k % 5 != 4)).alias("ok"))


@query("SELECT c_custkey, CASE WHEN starts_with(n, 'Customer#') THEN 'customers' ELSE split_part(n, '-', 1) END AS repository, replace(CASE WHEN starts_with(n, 'Customer#') THEN substr(n, 10) ELSE n END, '-', '_') AS name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Customer#' || c_custkey || '-x' ELSE 'other-' || c_custkey || '-y' END AS n FROM customer)")
def target_names(t):
    n = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("Customer#"), c("c_custkey").cast("string"), F.lit("-x"))).otherwise(F.concat(F.lit("other-"), c("c_custkey").cast("string"), F.lit("-y")))
    return t.customer.select("c_custkey", coerce.repository_of(n, [("Customer#", "customers")]).alias("repository"), coerce.name_of(n, ["Customer#"]).alias("name"))


@query("SELECT CAST(row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS INTEGER) AS no, n_name FROM nation")
def presentation_order(t):
    return records.presented(t.nation.withColumn("id", F.lpad(c("n_nationkey").cast("string"), 5, "0")), "n_name", "id").select("no", "n_name")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE value > 50 GROUP BY user_id")
def candidate_priority(t):
    return lookup.by_priority(t.events, "user_id", "event_id", "event_type", c("value") > 50)

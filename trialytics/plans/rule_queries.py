"""Queries over the test tables for the rules on files, documents, texts and records, with their SQL. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialytics.functions import coerce, text
from trialytics.operators import catalog, records, registry, validate
from trialytics.plans import batch
from trialytics.plans.queries import c, query
from trialytics.schemas import STAGES
from trialytics.sources import files
from trialytics.udf import bundle, mdtable


@query(r"""WITH s AS (SELECT p_partkey, '#include <' || p_name || '>  ' || chr(13) || chr(10) || 'int x;' || chr(10) || chr(9) || '#include "b.h"' || chr(9) || chr(10) || 'end' AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(replace(w, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_matches(x, '^\s*#include')), lambda x: regexp_replace(x, '\s+$', '')), '~') AS lines FROM s""")
def include_lines(t):
    source = F.concat(F.lit("#include <"), "p_name", F.lit('>  \r\nint x;\n\t#include "b.h"\t\nend'))
    return t.part.select("p_partkey", F.array_join(text.include_lines(source), "~").alias("lines"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'example') THEN 'first' WHEN contains(lower(url), '1') THEN 'second' ELSE '' END AS repository FROM pages")
def named_by_part(t):
    return t.pages.select("page_id", text.by_substring("url", [("Example", "first"), ("1", "second")]).alias("repository"))


OVERALL = "CASE o_orderkey % 6 WHEN 0 THEN 'Overall result: PASS' WHEN 1 THEN '| overall | fail |' WHEN 2 THEN 'overall status : failed' WHEN 3 THEN 'x' || chr(10) || 'OVERALL: Fail; overall: pass' WHEN 4 THEN 'overall pass' ELSE o_orderpriority END"


@query(rf"""SELECT o_orderkey, CASE WHEN regexp_matches(w, '(?i)\boverall\s*(?:result|status)?\s*[:|]\s*pass\b') THEN true WHEN regexp_matches(w, '(?i)\boverall\s*(?:result|status)?\s*[:|]\s*fail\b') THEN false END AS passed FROM (SELECT o_orderkey, {OVERALL} AS w FROM orders)""")
def overall_words(t):
    words = F.element_at(F.array(*map(F.lit, ("Overall result: PASS", "| overall | fail |", "overall status : failed", "x\nOVERALL: Fail; overall: pass", "overall pass")), c("o_orderpriority")), (c("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select("o_orderkey", text.overall_from_markdown(words).alias("passed"))


@query(r"""SELECT n_nationkey, array_to_string(list_sort(list_distinct(regexp_extract_all('reader.Get(a); reader.' || n_name || '(b); other.No(c); reader.Get(d); reader.Any (e)', '\breader\.(\w+)\(', 1))), '~') AS methods FROM nation""")
def called_methods(t):
    source = F.concat(F.lit("reader.Get(a); reader."), "n_name", F.lit("(b); other.No(c); reader.Get(d); reader.Any (e)"))
    return t.nation.select("n_nationkey", F.array_join(text.called_methods(source, "reader"), "~").alias("methods"))


@query("SELECT doc_id, CAST(length(left(text, o)) - length(replace(left(text, o), chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT doc_id, text, greatest(strpos(text, 'and') - 1, 0) AS o FROM documents)")
def offset_lines(t):
    return t.documents.select("doc_id", text.line_of_offset("text", F.greatest(F.instr("text", "and") - 1, F.lit(0))).alias("line"))


@query("SELECT p_partkey, replace(replace('{{NAME}} of {{BRAND}}, {{NAME}}; {{OTHER}}', '{{NAME}}', p_name), '{{BRAND}}', p_brand) AS filled FROM part")
def templates(t):
    return t.part.select("p_partkey", text.fill(F.lit("{{NAME}} of {{BRAND}}, {{NAME}}; {{OTHER}}"), {"NAME": c("p_name"), "BRAND": c("p_brand")}).alias("filled"))


@query(r"""WITH s AS (SELECT p_partkey, p_name || chr(10) || 'class A {' || chr(10) || ' x };' || chr(10) || '};' || chr(10) || 'tail };' || CASE WHEN p_partkey % 3 = 0 THEN 'class A {' ELSE '' END AS w FROM part),
p AS (SELECT *, CASE WHEN length(w) - length(replace(w, 'class A {', '')) = 9 THEN strpos(w, 'class A {') END AS s FROM s)
SELECT p_partkey, CAST(s AS BIGINT) AS "start", CAST(s + strpos(substr(w, s), chr(10) || '};') + 1 AS BIGINT) AS "end" FROM p""")
def sections(t):
    source = F.concat("p_name", F.lit("\nclass A {\n x };\n};\ntail };"), F.when(c("p_partkey") % 3 == 0, "class A {").otherwise(""))
    return t.part.select("p_partkey", text.locate_section(source, "class A {").alias("s")).select("p_partkey", "s.start", "s.end")


@query("SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN trim(s) = '' THEN s ELSE '    ' || s END), chr(10)) AS indented FROM conversations")
def indents(t):
    return t.conversations.select("conv_id", "turn", text.indent("text", "    ").alias("indented"))


SOURCES = """SELECT CASE p_partkey % 5 WHEN 0 THEN 'repo/build/' WHEN 1 THEN 'repo/third_party/' ELSE 'repo/src/' END || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.md' ELSE '.hpp' END AS path,
'class N' || (p_partkey % 11) || ' final : public B {};' || chr(10) || 'struct S;' || chr(10) || 'TEST_F(T' || (p_partkey % 4) || ', case' || (p_partkey % 9) || ') { }' AS value FROM part"""


def sources(t):
    k = c("p_partkey")
    folder = F.when(k % 5 == 0, "repo/build/").when(k % 5 == 1, "repo/third_party/").otherwise("repo/src/")
    value = F.concat(F.lit("class N"), (k % 11).cast("string"), F.lit(" final : public B {};\nstruct S;\nTEST_F(T"), (k % 4).cast("string"), F.lit(", case"), (k % 9).cast("string"), F.lit(") { }"))
    return t.part.select(F.concat(folder, k.cast("string"), F.when(k % 7 == 0, ".md").otherwise(".hpp")).alias("path"), value.alias("value"))


@query(f"SELECT regexp_extract(value, 'class (N[0-9]+)', 1) AS name, string_agg(path, '~' ORDER BY path) AS files FROM ({SOURCES}) WHERE path LIKE 'repo/src/%.hpp' GROUP BY 1")
def class_index(t):
    return files.class_index(sources(t)).select("name", F.array_join("files", "~").alias("files"))


@query(f"SELECT suite, string_agg(DISTINCT test, '~' ORDER BY test) AS tests FROM (SELECT regexp_extract(value, '(T[0-9]), ', 1) AS suite, regexp_extract(value, '(T[0-9]), ', 1) || '.' || regexp_extract(value, '(case[0-9])', 1) AS test FROM ({SOURCES}) WHERE path LIKE 'repo/src/%.hpp') GROUP BY 1")
def test_index(t):
    return files.test_index(sources(t)).select("suite", F.array_join("tests", "~").alias("tests"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'not_recorded' WHEN o_orderkey % 5 = 1 OR o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 5 IN (2, 3) THEN 'passed' ELSE 'unknown' END AS status,
CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'N/A' END AS label, CASE o_orderstatus WHEN 'F' THEN 'はい' WHEN 'O' THEN 'いいえ' ELSE '不明' END AS answer FROM orders""")
def status_words(t):
    k = c("o_orderkey")
    reason = F.element_at(F.array(*map(F.lit, ("stop", " Length ", "STOP", "completed", "load"))), (k % 5 + 1).cast("int"))
    known = F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False)
    return t.orders.select("o_orderkey", coerce.generation_status(k % 5 != 0, reason, F.when(k % 3 == 0, "broken").otherwise("")).alias("status"), coerce.bool_label(known).alias("label"), coerce.yes_no(known).alias("answer"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND contains(lower(g), 'module') THEN 'module_files' WHEN p_partkey % 3 = 0 AND contains(lower(g), 'class') THEN 'class_span' WHEN p_partkey % 3 = 1 AND (contains(lower(g), 'class') OR n = 'INIReader') THEN 'class_span' ELSE g END AS granularity
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Module' WHEN 1 THEN 'a class' WHEN 2 THEN 'function' ELSE '' END AS g, CASE WHEN p_partkey % 5 = 0 THEN 'INIReader' ELSE p_name END AS n FROM part)""")
def granularities(t):
    k = c("p_partkey")
    given = F.element_at(F.array(*map(F.lit, ("Module", "a class", "function", ""))), (k % 4 + 1).cast("int"))
    repository = F.when(k % 3 == 0, "Echo-Web-Server").when(k % 3 == 1, "ini-cpp").otherwise("other")
    return t.part.select("p_partkey", catalog.normalize_granularity(given, repository, F.when(k % 5 == 0, "INIReader").otherwise(c("p_name"))).alias("granularity"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def stale_drafts(t):
    k = c("c_custkey")
    existing = t.customer.select("c_custkey", (k % 2 == 0).alias("readable"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("enabled"))
    return registry.stale(existing, t.orders.select(c("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 'old' FROM region UNION ALL SELECT 'pilot::' || s_suppkey, s_name, NULL FROM supplier")
def record_union(t):
    standard = t.nation.select(c("n_nationkey").cast("string").alias("id"), c("n_name").alias("name"))
    legacy = t.region.select(c("r_regionkey").cast("string").alias("id"), c("r_name").alias("name"), F.lit("old").alias("note"))
    pilots = t.supplier.select(F.concat(F.lit("pilot::"), c("s_suppkey").cast("string")).alias("id"), c("s_name").alias("name"))
    return records.union_records(standard, legacy, pilots)


def customer_documents(t):
    """path, value: JSON objects, a list, broken text and an object behind a byte-order mark, one for each customer."""
    k = c("c_custkey")
    named = F.concat(F.lit('{"n": "'), "c_name", F.lit('"}'))
    return t.customer.select(F.concat(F.lit("d/"), k.cast("string"), F.lit(".json")).alias("path"), F.when(k % 4 == 0, named).when(k % 4 == 1, F.lit("[1]")).when(k % 4 == 2, F.lit("{")).otherwise(named).alias("value"))


@query("SELECT 'd/' || k || '.json' AS path, CASE WHEN c_custkey % 4 IN (0, 3) THEN c_name END AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL) LEFT JOIN customer ON c_custkey = k")
def json_or_empty(t):
    expected = t.orders.where("o_custkey is not null").select(F.concat(F.lit("d/"), c("o_custkey").cast("string"), F.lit(".json")).alias("path")).distinct()
    return files.json_or_empty(expected, customer_documents(t)).select("path", F.try_variant_get("doc", "$.n", "string").alias("n"))


@query("SELECT 'd/' || c_custkey || '.json' AS path, c_name AS n FROM customer WHERE c_custkey % 4 IN (0, 3)")
def json_objects(t):
    return files.json_objects(customer_documents(t)).select("path", F.try_variant_get("doc", "$.n", "string").alias("n"))


PAGE_FILES = "SELECT 'root/' || (page_id % 50) || '/' || CASE page_id % 3 WHEN 0 THEN 'a.json' WHEN 1 THEN 'sub/b.json' ELSE 'b.json' END || CASE WHEN page_id >= 150 THEN '.' || page_id ELSE '' END AS path, CAST(page_id % 50 AS BIGINT) AS id, html AS value, page_id FROM pages"


def page_files(t):
    k = c("page_id")
    name = F.when(k % 3 == 0, "a.json").when(k % 3 == 1, "sub/b.json").otherwise("b.json")
    path = F.concat(F.lit("root/"), (k % 50).cast("string"), F.lit("/"), name, F.when(k >= 150, F.concat(F.lit("."), k.cast("string"))).otherwise(""))
    return t.pages.select(path.alias("path"), (k % 50).cast("bigint").alias("id"), c("html").alias("value"), "page_id")


@query(f"""WITH f AS ({PAGE_FILES}), m AS (SELECT id, path, CASE WHEN path = 'root/' || id || '/b.json' THEN 1 WHEN path = 'root/' || id || '/sub/b.json' THEN 2 END AS p FROM f)
SELECT id, arg_min(path, p) AS path FROM m WHERE p IS NOT NULL GROUP BY id""")
def first_candidates(t):
    docs = page_files(t)
    root = F.concat(F.lit("root/"), c("id").cast("string"))
    ids = docs.select("id").distinct().withColumn("at", F.array(F.concat(root, F.lit("/b.json")), F.concat(root, F.lit("/sub/b.json")), F.concat(root, F.lit("/none"))))
    return files.first_candidates(ids, docs.select("path", "value"), "id", "at").select("id", "path")


@query(f"""WITH f AS ({PAGE_FILES}), m AS (SELECT 'root/' || id AS root, path, path NOT LIKE '%/sub/%' AS direct, CASE WHEN path LIKE '%/b.json' THEN 1 ELSE 2 END AS p FROM f WHERE path LIKE '%/a.json' OR path LIKE '%/b.json')
SELECT root, arg_min(path, (NOT direct, CASE WHEN direct THEN p ELSE 0 END, path)) AS path FROM m GROUP BY root""")
def first_named(t):
    docs = page_files(t).withColumn("root", F.concat(F.lit("root/"), c("id").cast("string")))
    return files.first_named(docs, "root", ["b.json", "a.json"])


@query(f"""WITH s AS ({SOURCES}), e AS (SELECT n_nationkey, unnest(['repo/src/' || n_nationkey || '.hpp', 'repo/src/none.hpp', 'repo/build/' || (n_nationkey + 5) || '.hpp']) AS path FROM nation)
SELECT n_nationkey, CAST(sum(3 * (value IS NOT NULL)::INT) FILTER (WHERE value IS NOT NULL) AS BIGINT) AS loc, CAST(sum(length(value)) AS BIGINT) AS chars FROM e LEFT JOIN s USING (path) GROUP BY n_nationkey""")
def configured_sizes(t):
    k = c("n_nationkey")
    listed = F.array(F.concat(F.lit("repo/src/"), k.cast("string"), F.lit(".hpp")), F.lit("repo/src/none.hpp"), F.concat(F.lit("repo/build/"), (k + 5).cast("string"), F.lit(".hpp")))
    return files.configured_sizes(t.nation.select("n_nationkey", listed.alias("files")), sources(t), "n_nationkey", "files")


@query(f"SELECT CAST(sum(3) AS BIGINT) AS loc, CAST(sum(length(value)) AS BIGINT) AS chars FROM ({SOURCES}) WHERE path LIKE '%.hpp'")
def selected_sizes(t):
    return files.sizes(sources(t).where(files.has_suffix("path")))


@query("""WITH d AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'study/' ELSE 'study/exp/' END || page_id || '.log' AS path, html AS value FROM pages),
s AS (SELECT page_id, page_id || '.log' AS e, (page_id + 1) || '.log' AS o FROM pages)
SELECT page_id, sha256(nullif(concat_ws(chr(10), coalesce(a.value, b.value), coalesce(x.value, y.value)), '')) AS log FROM s LEFT JOIN d a ON a.path = 'study/' || e LEFT JOIN d b ON b.path = 'study/exp/' || e LEFT JOIN d x ON x.path = 'study/' || o LEFT JOIN d y ON y.path = 'study/exp/' || o""")
def stage_logs(t):
    k = c("page_id")
    docs = t.pages.select(F.concat(F.when(k % 2 == 0, "study/").otherwise("study/exp/"), k.cast("string"), F.lit(".log")).alias("path"), c("html").alias("value"))
    stages = t.pages.select("page_id", F.concat(k.cast("string"), F.lit(".log")).alias("stderr_log"), F.concat((k + 1).cast("string"), F.lit(".log")).alias("stdout_log"), F.lit("study/exp").alias("exp_dir"))
    return files.stage_logs(stages, docs, "exp_dir", "study").select("page_id", F.sha2("log", 256).alias("log"))


@query("""SELECT c_custkey, c_name AS name, CAST(c_custkey AS VARCHAR) AS num_ctx, CAST(NULL AS VARCHAR) AS top_p, 'p' AS provider, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'n' END AS model, CAST(length(c_name) AS BIGINT) AS prompt_chars, CAST(CASE WHEN c_custkey % 3 = 0 THEN length(c_mktsegment) END AS BIGINT) AS response_chars, CAST(NULL AS BIGINT) AS system_chars,
CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name END AS reply FROM customer""")
def model_exchanges(t):
    k = c("c_custkey")
    run = F.parse_json(F.concat(F.lit('{"provider": "p", "model": {"name": "'), "c_name", F.lit('"}, "generation": {"options": {"num_ctx": '), k.cast("string"), F.lit("}}}")))
    request = F.parse_json(F.concat(F.lit('{"system": 7, "prompt": "'), "c_name", F.lit('"'), F.when(k % 2 == 0, ', "model": "m"').otherwise(""), F.lit("}")))
    response = F.parse_json(F.when(k % 3 == 0, F.concat(F.lit('{"model": "n", "response": "'), "c_mktsegment", F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('{"model": "n", "message": {"content": "'), "c_name", F.lit('"}}'))).otherwise(F.lit('{"model": "n", "response": 5}')))
    rows = t.customer.select("c_custkey", run.alias("run"), request.alias("q"), response.alias("a"))
    made = rows.select("c_custkey", coerce.model_of("run").alias("m"), coerce.exchange("q", "a").alias("x"), coerce.response_text("a").alias("reply"))
    return made.select("c_custkey", "m.name", "m.num_ctx", "m.top_p", "m.provider", "x.model", "x.prompt_chars", "x.response_chars", "x.system_chars", "reply")


@query("""SELECT s_suppkey, 'repos/' || s_suppkey AS local_path, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'NOT_A_GIT_REPOSITORY' END AS origin_url, CASE WHEN s_suppkey % 3 = 0 THEN sha256(s_name) ELSE 'NOT_A_GIT_REPOSITORY' END AS "commit" FROM supplier""")
def repository_inventory(t):
    k = c("s_suppkey")
    entries = t.supplier.select(k.alias("repository_id"), F.concat(F.lit("repos/"), k.cast("string")).alias("local_path"), c("s_name").alias("origin_url"), F.sha2("s_name", 256).alias("commit"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_git"))
    return files.repositories(entries).withColumnRenamed("repository_id", "s_suppkey")


@query("""SELECT n_nationkey, n_name || '=' || '採用' AS bullets, CASE WHEN n_nationkey % 2 = 0 THEN 'T' || n_nationkey || '=除外=' || n_name ELSE '' END AS judgments FROM nation""")
def report_lines(t):
    k = c("n_nationkey").cast("string")
    report = F.concat(F.lit("x\n  - **`"), "n_name", F.lit("` — 採用 **\n* **no — 採用**\n| T"), k, F.when(c("n_nationkey") % 2 == 0, " | 除外 | ").otherwise(" | 保留 | "), "n_name", F.lit(" |\nend"))
    found = t.nation.select("n_nationkey", text.bullets(report).alias("b"), text.judgments(report).alias("j"))
    return found.select("n_nationkey", F.array_join(F.transform("b", lambda x: F.concat_ws("=", x["name"], x["status"])), "~").alias("bullets"), F.array_join(F.transform("j", lambda x: F.concat_ws("=", x["name"], x["status"], x["notes"])), "~").alias("judgments"))


RULES = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 'class_span' ELSE 'module_files' END AS g, CASE o_orderkey % 5 WHEN 0 THEN 'whole_source_files_fallback' WHEN 1 THEN 'class_span_design_input_fallback' ELSE 'legacy_backup_tree_fallback' END AS scope,
o_orderkey % 7 = 0 AS retry, CASE o_orderkey % 6 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END AS code, CASE WHEN o_orderkey % 11 < 5 THEN 'passed' ELSE 'failed' END AS code_status, CASE WHEN o_orderkey % 8 = 0 THEN 'stop' END AS design, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE 'passed' END AS design_status, CASE WHEN o_orderkey % 9 > 0 THEN 5 END AS loc, o_orderkey % 2 = 0 AS legacy FROM orders"""


@query(f"""WITH r AS ({RULES}) SELECT id, 1 AS rule_no FROM r WHERE ok IS NULL UNION ALL SELECT id, 2 FROM r WHERE g = 'class_span' AND scope IN ('whole_source_files_fallback', 'whole_source_files_repository_fallback', 'legacy_backup_tree_fallback')
UNION ALL SELECT id, 3 FROM r WHERE ok AND code_status = 'failed' UNION ALL SELECT id, 4 FROM r WHERE retry UNION ALL SELECT id, 5 FROM r WHERE code = 'stop' AND loc IS NULL AND NOT legacy UNION ALL SELECT id, 6 FROM r WHERE design = 'stop' AND design_status <> 'passed'
UNION ALL SELECT id, 7 FROM r WHERE (code = 'stop' AND code_status <> 'passed') OR (code = 'length' AND code_status <> 'failed')""")
def record_rules(t):
    k = c("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    states = {f"{s}_status": F.lit("passed") for s in STAGES} | {"code_regeneration_status": F.when(k % 11 < 5, "passed").otherwise("failed"), "design_generation_status": F.when(k % 13 == 0, "unknown").otherwise("passed")}
    rows = t.orders.select(
        k.alias("id"), pick(4, True, False, True, None).alias("overall_pass"), F.when(k % 3 == 0, "class_span").otherwise("module_files").alias("granularity"),
        F.when(k % 5 == 0, "whole_source_files_fallback").when(k % 5 == 1, "class_span_design_input_fallback").otherwise("legacy_backup_tree_fallback").alias("original_measurement_scope"),
        (k % 7 == 0).alias("retry_performed"), F.lit(None).cast("boolean").alias("automatic_repair_performed"), F.when(k % 6 == 0, "stop").when(k % 6 == 1, "length").alias("code_done_reason"),
        F.when(k % 8 == 0, "stop").alias("design_done_reason"), F.when(k % 9 > 0, 5).alias("generated_loc"), (k % 2 == 0).alias("legacy_format"), *(v.alias(n) for n, v in states.items()),
    )
    return validate.violations(rows, "id", validate.record_rules()).select("id", "rule_no")


@query("SELECT c_custkey AS target_id, CASE WHEN c_custkey % 3 = 0 THEN 'ready' ELSE 'disabled' END AS status FROM customer")
def batch_plan(t):
    k = c("c_custkey")
    value = F.concat(F.lit('{"target_id": "'), k.cast("string"), F.lit('"'), F.when(k % 3 == 0, ', "enabled": true').when(k % 3 == 1, ', "enabled": "true"').otherwise(""), F.lit("}"))
    configs = files.json_objects_strict(t.customer.select(F.lpad(k.cast("string"), 9, "0").alias("path"), value.alias("value")))
    return batch.public(batch.plan(configs).withColumn("stdout", F.lit("x")).withColumn("_own", F.lit(1))).select(c("target_id").cast("bigint").alias("target_id"), "status")


@query("""SELECT n_regionkey AS key, string_agg('===== FILE: ' || n_name || '.hpp =====' || chr(10) || '#include <' || (n_nationkey % 2) || '>' || chr(10) || 'int f() { return 1; }' || chr(10), chr(10) ORDER BY n_nationkey) AS design,
string_agg('===== FILE: ' || n_name || '.hpp =====' || chr(10) || '#include <' || (n_nationkey % 2) || '>' || chr(10) || 'int f() ;' || chr(10), chr(10) ORDER BY n_nationkey) AS scaffold,
(SELECT string_agg('#include <' || m || '>', chr(10) ORDER BY first) FROM (SELECT i.n_nationkey % 2 AS m, min(i.n_nationkey) AS first FROM nation i WHERE i.n_regionkey = nation.n_regionkey GROUP BY 1)) || chr(10) AS dependency FROM nation GROUP BY n_regionkey""")
def design_parts(t):
    k = c("n_nationkey")
    source = F.concat(F.lit("#include <"), (k % 2).cast("string"), F.lit(">\nint f() { return 1; }\n\n"))
    rows = t.nation.select(c("n_regionkey").alias("key"), k.alias("no"), F.concat("n_name", F.lit(".hpp")).alias("name"), source.alias("text"))
    return bundle.parts_of(rows, "key", "no", "name", "text")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS i, array_to_string(list_transform(string_split(line, ', '), lambda x: trim(x)), '~') AS cells FROM l WHERE contains(line, ', ') AND NOT contains(line, '|')""")
def md_cells_of_lines(t):
    """Table rows made of the lines that list something, and split again."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(c("line").contains(", ") & ~c("line").contains("|"))
    row = F.concat(F.lit("  |  "), F.replace("line", F.lit(", "), F.lit(" |")), F.lit(" | "))
    return rows.select("doc_id", "i", F.array_join(text.markdown_cells(row), "~").alias("cells"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def stale_rows(t):
    """Readable rows that aren't enabled and that no urgent, pending order expects."""
    k = c("c_custkey")
    existing = t.customer.select("c_custkey", (k % 2 == 0).alias("readable"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("enabled"))
    expected = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return registry.stale(existing, expected, "c_custkey").select("c_custkey")


LISTED = "SELECT 'configs/' || CASE WHEN s_suppkey % 5 = 0 THEN 'sub/' ELSE '' END || s_name || CASE s_suppkey % 4 WHEN 0 THEN '.draft.json' WHEN 1 THEN '.json' WHEN 2 THEN '.json.bak' ELSE '.md' END AS path FROM supplier"


def listed(t):
    k = c("s_suppkey")
    end = F.when(k % 4 == 0, ".draft.json").when(k % 4 == 1, ".json").when(k % 4 == 2, ".json.bak").otherwise(".md")
    return t.supplier.select(F.concat(F.lit("configs/"), F.when(k % 5 == 0, "sub/").otherwise(""), "s_name", end).alias("path"))


@query(f"SELECT path FROM ({LISTED}) WHERE path LIKE '%.json' AND path NOT LIKE '%.draft.json'")
def final_configs(t):
    return files.configs(listed(t))


@query(f"SELECT path FROM ({LISTED}) WHERE path LIKE '%.draft.json' AND regexp_extract(path, '([^/]*)\\.draft\\.json$', 1) IN (SELECT s_name FROM supplier WHERE s_nationkey < 12)")
def draft_configs(t):
    """Drafts of the targets that are asked for: the 12 first nations' suppliers, whose names are few."""
    wanted = t.supplier.where("s_nationkey < 12").select(F.concat(F.lit("configs/"), "s_name", F.lit(".draft.json")).alias("path"))
    drafts = files.configs(listed(t), drafts=True).withColumn("base", files.base_name("path"))
    return drafts.join(wanted.select(files.base_name("path").alias("base")), "base", "left_semi").select("path")


@query("SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id) WHERE CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END = false")
def failed_records(t):
    """The projection of failed records: an unknown outcome is no failure."""
    rows = t.documents.join(t.labels, "doc_id").withColumn("overall_pass", F.when(c("toxic") != 1, c("quality") == 1))
    return rows.where(c("overall_pass") == F.lit(False)).select("doc_id", "lang", "source")


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 'not ' || props FROM events WHERE event_id % 3 = 0")
def pretty_json(t):
    """JSON texts indented by two; others as they are."""
    from trialytics.udf.jsontext import pretty

    return t.events.select("event_id", pretty(F.when(c("event_id") % 3 == 0, F.concat(F.lit("not "), "props")).otherwise(c("props"))).alias("pretty"))


@query("SELECT page_id, length(html) > 0 AS readable, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages WHERE page_id % 4 > 0 UNION ALL SELECT page_id, false, CAST(octet_length(encode(html)) + 1 AS BIGINT) FROM pages WHERE page_id % 4 = 0")
def readable_documents(t):
    """Whether files' bytes are UTF-8: every fourth ends with a byte that no such text holds."""
    from trialytics.plans import study

    content = F.when(c("page_id") % 4 == 0, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("html", "UTF-8"))
    rows = t.pages.select("page_id", content.alias("content")).withColumn("readable", F.is_valid_utf8(c("content").cast("string"))).withColumn("value", F.make_valid_utf8(c("content").cast("string")))
    return rows.select("page_id", (F.length(F.coalesce(study.read_text(), F.lit(""))) > 0).alias("readable"), F.length("content").cast("bigint").alias("bytes"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS path, 1 AS table_no, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS row_no, 'Key~Customer' AS header, c_custkey || '~' || c_name AS cells FROM customer")
def md_tables_of_lines(t):
    """A report of each nation's customers, whose lines come to the table function one by one."""
    path, named = c("c_nationkey").cast("string").alias("path"), F.concat(F.lit("| "), c("c_custkey").cast("string"), F.lit(" | "), "c_name", F.lit(" |"))
    fixed = F.array(*(F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(line).alias("line")) for i, line in enumerate(("Customers | all", "", "| Key | Customer |", "|---|:---:|"), -4)))
    heads = t.customer.select(path).distinct().select("path", F.explode(fixed).alias("l")).select("path", "l.place", "l.line")
    rows = mdtable.tables_of_lines(heads.unionByName(t.customer.select(path, c("c_custkey").cast("bigint").alias("place"), named.alias("line"))), "path", "place", "line")
    return rows.select("path", "table_no", "row_no", F.array_join("header", "~").alias("header"), F.array_join("cells", "~").alias("cells"))

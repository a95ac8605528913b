"""Catalogue bootstrap, readiness and batch reports."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialytics.functions import text
from trialytics.functions.coerce import first_nonempty, nonempty, nonempty_array
from trialytics.functions.text import find_column, slug, strip_marks
from trialytics.operators import catalog, groups
from trialytics.sinks import reports
from trialytics.sources import files

# Words by which a report's columns are known, in order of preference; what a target must have; what an execution needs besides.
REPORT_WORDS = {
    "target": ("target", "対象"),
    "judgment": ("判定", "status"),
    "granularity": ("granularity", "scope", "粒度"),
    "source": ("宣言・実装", "source", "実装"),
    "test": ("対応test", "test file", "テスト"),
    "count": ("選択数", "discovered"),
    "names": ("選択テスト名", "test names"),
    "filter": ("filter",),
}
REQUIRED = ("granularity", "source_files", "direct_test_filter", "expected_direct_tests", "expected_full_tests")
EXECUTION = ("verified replacement locator", "fixed scaffold/dependency context", "verified Docker image", "configure/build/test commands", "stage_commands")
READINESS = ("repository_id", "target_id", "target_name", "adoption_status", "granularity", "source_files", "test_files", "direct_test_count", "direct_test_filter", "expected_full_tests", "metadata_complete", "metadata_missing", "execution_ready", "execution_missing", "notes")
READINESS_TITLES = {"repository_id": "repository", "target_name": "target", "adoption_status": "adoption", "granularity": "granularity", "sources": "source files", "direct_test_count": "direct tests", "expected_full_tests": "full tests", "metadata": "metadata", "execution": "execution"}
MODEL = {"name": "qwen2.5-coder:32b", "temperature": 0, "seed": 42, "num_ctx": 8192, "num_predict": 2048, "top_k": 40, "top_p": 0.9, "repeat_penalty": 1.1, "stream": False, "generations": 1, "retry": False, "automatic_repair": False}
COMMANDS = ("docker_image", "configure_command", "build_command", "direct_test_command", "full_test_command", "ctest_command")
FIELDS = {"adoption_status": "string", "granularity": "string", "source_descriptor": "string", "source_files": "array<string>", "test_descriptor": "string", "test_files": "array<string>",
    "direct_test_count": "bigint", "direct_test_names": "array<string>", "direct_test_filter": "string", "expected_full_tests": "bigint", "notes": "string"}


def catalog_records(docs: DataFrame, columns: Mapping[str, Sequence[str]], path: str = "path", text: str = "text") -> DataFrame:
    """Catalogue records of reports: each table with a `target` column gives updates, folded first-non-empty by name.

    columns: for each field the header keywords, in order of preference.
    """
    rows = catalog.table_rows(docs, path, text)
    for name, words in columns.items():
        rows = rows.withColumn(f"_{name}", find_column("header", words))
    rows = rows.where("_target > 0").select(path, "table_no", "row_no", *(F.when(F.col(f"_{n}") > 0, F.try_element_at("cells", F.col(f"_{n}").cast("int"))).alias(n) for n in columns))
    rows = rows.withColumn("target", strip_marks("target")).withColumn("key", F.lower("target")).withColumn("seq", F.struct(path, "table_no", "row_no"))
    return catalog.fold_first(rows, "key", "seq", list(columns)).withColumn("target_id", slug("target"))


def _updates(docs: DataFrame, repositories: Sequence[tuple[str, str]]) -> DataFrame:
    """What each line of a report tells of a target: repository_id, name, seq and FIELDS. Tables come before bullets, bullets before judgments."""
    stem = F.regexp_replace(files.base_name("path"), r"\.[^.]*$", "")
    named = docs.select("path", "value", F.coalesce(nonempty(text.by_substring(stem, repositories)), F.replace(stem, F.lit("_report"), F.lit(""))).alias("repository_id"), text.repeated_count("value").alias("expected_full_tests"))
    about = named.select("path", "repository_id", "expected_full_tests")

    rows = catalog.table_rows(named, "path", "value")
    at = {n: find_column("header", words) for n, words in REPORT_WORDS.items()}
    cell = {n: F.when(p > 0, F.try_element_at("cells", p.cast("int"))) for n, p in at.items()}
    names = F.filter(F.transform(F.split(cell["names"], ","), lambda x: F.trim(x)), lambda x: x != "")
    narrowed = F.btrim(cell["filter"], F.lit("` "))
    told = {
        "name": strip_marks(cell["target"]), "adoption_status": cell["judgment"], "granularity": cell["granularity"], "source_descriptor": cell["source"], "source_files": text.source_paths(cell["source"]), "test_descriptor": cell["test"], "test_files": text.source_paths(cell["test"]),
        "direct_test_count": F.coalesce(text.first_int(cell["count"]), text.first_int(narrowed)), "direct_test_names": names, "direct_test_filter": F.when(at["filter"] > 0, narrowed).otherwise(F.array_join(names, ":")),
    }
    tables = rows.where(at["target"] > 0).select("path", F.struct(F.lit(0).alias("kind"), F.col("table_no").cast("int").alias("a"), F.col("row_no").cast("int").alias("b")).alias("place"), *(v.alias(n) for n, v in told.items()))
    tables = tables.where((F.col("name") != "") & ~F.lower("name").isin("target", "対象"))

    def listed(kind: int, found: Column, **fields: str) -> DataFrame:
        spread = named.select("path", F.posexplode(found).alias("a", "x"))
        return spread.select("path", F.struct(F.lit(kind).alias("kind"), F.col("a"), F.lit(0).alias("b")).alias("place"), *(F.col(f"x.{v}").alias(k) for k, v in fields.items()))

    points = listed(1, text.bullets("value"), name="name", adoption_status="status")
    judged = listed(2, text.judgments("value"), name="name", adoption_status="status", notes="notes")
    out = tables.unionByName(points, allowMissingColumns=True).unionByName(judged, allowMissingColumns=True).join(about, "path")
    return out.withColumn("seq", F.struct("path", "place"))


def report_records(docs: DataFrame, repositories: Sequence[tuple[str, str]], defaults: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """Catalogue records of study reports (path, value): of each target the first non-empty value of every field, notes joined.

    repositories: (part of a report's name, repository). defaults: the source of (repository,
    target name) where no report names one.
    """
    rows = _updates(docs, repositories).withColumn("key", F.lower("name"))

    def first(field: str, kind: str) -> Column:
        there = {"string": nonempty, "array<string>": nonempty_array}.get(kind, F.col)(field)
        return F.min_by(there, F.when(there.isNotNull(), F.col("seq"))).alias(field)

    once = rows.groupBy("repository_id", "key").agg(F.min_by("name", "seq").alias("target_name"), *(first(f, k) for f, k in FIELDS.items() if f != "notes"))
    notes = catalog.fold_notes(rows.withColumn("both", F.struct("repository_id", "key")), "both", "seq", "notes").select("both.*", "notes")
    out = once.join(notes, ["repository_id", "key"]).drop("key")
    source = F.coalesce(*(F.when((F.col("repository_id") == r) & (F.lower("target_name") == n.lower()), F.lit(s)) for (r, n), s in (defaults or {}).items()), F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    out = out.withColumns({
        "target_id": F.concat_ws("-", slug("repository_id"), slug("target_name")), "source_descriptor": F.coalesce("source_descriptor", source), "source_files": F.coalesce("source_files", F.when(source.isNotNull(), F.array(source)), none),
        "test_files": F.coalesce("test_files", none), "direct_test_names": F.coalesce("direct_test_names", none), "granularity": catalog.normalize_granularity(F.coalesce("granularity", F.lit("")), F.col("repository_id"), F.col("target_name")),
    }).withColumn("direct_test_filter", first_nonempty("direct_test_filter", F.array_join("direct_test_names", ":")))
    blank = [f for f in ("adoption_status", "granularity", "source_descriptor", "test_descriptor", "direct_test_filter", "notes")]
    return out.withColumns({f: F.coalesce(f, F.lit("")) for f in blank}).select("repository_id", "target_id", "target_name", *FIELDS)


def with_readiness(df: DataFrame) -> DataFrame:
    """Records with what is missing, of their metadata and for an execution."""
    empty = {"granularity": F.col("granularity") == "", "source_files": F.size("source_files") == 0, "direct_test_filter": F.col("direct_test_filter") == "", "expected_direct_tests": F.col("direct_test_count").isNull(), "expected_full_tests": F.col("expected_full_tests").isNull()}
    out = df.withColumn("metadata_missing", catalog.missing_fields([(n, empty[n]) for n in REQUIRED]))
    return out.withColumns({"metadata_complete": F.size("metadata_missing") == 0, "execution_ready": F.lit(False), "execution_missing": F.concat("metadata_missing", F.array(*map(F.lit, EXECUTION)))})


def readiness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """metadata_missing (names in order) and metadata_complete."""
    missing = catalog.missing_fields([(f, F.coalesce(F.col(f).cast("string"), F.lit("")) == "") for f in fields])
    return df.withColumn("metadata_missing", missing).withColumn("metadata_complete", F.size("metadata_missing") == 0)


def draft(row: Mapping) -> dict:
    """A target's draft configuration, of a record with its readiness."""
    sources = row["source_files"]
    return {
        "schema_version": "2.0", "enabled": False, "target_id": row["target_id"], "experiment_id": f"{row['target_id']}-roundtrip", **{n: row[n] for n in ("repository_id", "target_name", "adoption_status", "granularity", "source_files", "test_files")},
        "source_descriptor_from_report": row["source_descriptor"], "locator": {}, "design_input": {"source_files": sources, "extra_context_files": []},
        "regeneration_input": {"fixed_scaffold_files": [], "dependency_context_files": [], "output_mode": "file_map_json" if row["granularity"] == "module_files" else "single_code"},
        "evaluation": {"direct_test_filter": row["direct_test_filter"], "direct_test_names": row["direct_test_names"], "expected_direct_tests": row["direct_test_count"], "expected_full_tests": row["expected_full_tests"], **dict.fromkeys(COMMANDS, "")},
        "model": MODEL, "stage_commands": {}, "readiness": {n: row[n] for n in ("metadata_complete", "metadata_missing", "execution_ready", "execution_missing")}, "notes": row["notes"],
    }


def write_readiness(kept: DataFrame, excluded: DataFrame, folder: str, expected: int | None = None) -> None:
    """batch_readiness.csv and .md of records with readiness."""
    ordered = kept.orderBy(F.lower("repository_id"), F.lower("target_name"))
    lists = ("source_files", "test_files", "metadata_missing", "execution_missing")
    reports.write_csv(ordered.withColumns({n: F.array_join(n, ";") for n in lists}), os.path.join(folder, "batch_readiness.csv"), READINESS)
    shown = ordered.withColumns({
        "sources": F.size("source_files"), "metadata": F.when(F.col("metadata_complete"), "COMPLETE").otherwise("INCOMPLETE"), "execution": F.lit("DRAFT"),
        **{n: F.coalesce(nonempty(F.col(n).cast("string")), F.lit("N/A")) for n in ("adoption_status", "granularity", "direct_test_count", "expected_full_tests")},
    })
    total, complete = ordered.agg(F.count("*"), F.count_if("metadata_complete")).head()
    out = excluded.orderBy("repository_id", "target_name").select("repository_id", "target_name", "adoption_status")
    lines = [f"- `{r[0]}/{r[1]}`: {r[2]}" for r in out.toLocalIterator()]
    head = ["# Round-trip batch readiness", "", f"- targets: **{total}**", f"- metadata complete: **{complete}**", f"- excluded: **{len(lines)}**"]
    head += [f"- expected targets: **{expected}**"] * (expected is not None)
    with open(os.path.join(folder, "batch_readiness.md"), "w", encoding="utf-8", newline="\n") as file:
        file.write("\n".join([*head, "", reports.markdown_table(shown, READINESS_TITLES), "## Excluded", "", *(lines or ["- none"])]) + "\n")


def enabled_only(configs: DataFrame, flag: str = "enabled") -> DataFrame:
    """Rows whose flag is true; null and other values aren't."""
    return configs.where(F.coalesce(F.col(flag), F.lit(False)))


def plan(configs: DataFrame) -> DataFrame:
    """target_id, status (ready, or disabled unless `enabled` is the boolean true), config of configurations (path, doc), in order of path."""
    ready = F.schema_of_variant(F.try_variant_get("doc", "$.enabled", "variant")) == "BOOLEAN"
    on = ready & F.try_variant_get("doc", "$.enabled", "boolean")
    return configs.select(F.try_variant_get("doc", "$.target_id", "string").alias("target_id"), F.when(on, "ready").otherwise("disabled").alias("status"), F.col("path").alias("config")).orderBy("config")


def public(rows: DataFrame) -> DataFrame:
    """Without captured output and private columns."""
    return rows.drop("stdout", "stderr", *(c for c in rows.columns if c.startswith("_")))


def write_batch_report(rows: DataFrame, json_path: str, markdown_path: str) -> None:
    """Rows as a JSON list without captured output; a Markdown table with status counts."""
    shown = public(rows)
    reports.write_json(reports.rows_as_json(shown), json_path)
    with open(markdown_path, "w", encoding="utf-8", newline="\n") as out:
        out.write(f"- generated_at: `{reports.utc_now()}`\n\n" + reports.markdown_table(groups.histogram(shown, "status").orderBy("status")) + "\n" + reports.markdown_table(shown))

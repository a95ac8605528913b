"""File sources: tolerant and strict JSON objects, CSV manifests, listings, text trees, logs. Spark's readers do all reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.functions.text import SOURCE_SUFFIXES, class_declarations, line_count, test_declarations

BOM = "\ufeff"
#: Folders that header scans leave out.
LEFT_OUT = ("build", ".git", "third_party", "vendor")


def texts(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """path, value: whole texts without a byte-order mark. A path that matches nothing gives no rows."""
    reader = spark.read.option("wholetext", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path if isinstance(path, str) else list(path)).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^" + BOM, "").alias("value"))


def _is_object(v: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_objects(docs: DataFrame) -> DataFrame:
    """path, doc (variant): the texts that are JSON objects; others are left out."""
    return docs.withColumn("doc", F.try_parse_json("value")).where(_is_object("doc")).select("path", "doc")


def json_objects_strict(docs: DataFrame) -> DataFrame:
    """The same, but any other text fails the query."""
    parsed = docs.withColumn("doc", F.try_parse_json("value"))
    checked = F.when(_is_object("doc"), F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("path"))).cast("variant"))
    return parsed.select("path", checked.alias("doc"))


def json_or_empty(expected: DataFrame, docs: DataFrame) -> DataFrame:
    """path, doc for every expected path; an empty object where there is no readable one."""
    return expected.join(json_objects(docs), "path", "left").select("path", F.coalesce("doc", F.parse_json(F.lit("{}"))).alias("doc"))


def csv_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A manifest: header, quotes, byte-order mark, all strings. Columns are named, never inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').option("enforceSchema", "false").csv(path)


def base_name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def configs(docs: DataFrame, drafts: bool = False, targets: Sequence[str] = ()) -> DataFrame:
    """Configuration files in order of path: finals, or drafts, of the given targets only if any are given."""
    is_draft = base_name("path").endswith(".draft.json")
    out = docs.where(is_draft if drafts else ~is_draft & base_name("path").endswith(".json"))
    if targets:
        out = out.where(F.regexp_replace(base_name("path"), r"(\.draft)?\.json$", "").isin(*targets))
    return out.orderBy("path")


def has_suffix(path: str, suffixes: Sequence[str] = SOURCE_SUFFIXES) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)).isin(*suffixes)


def sizes(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, loc, chars: lines and characters of all texts of a key."""
    return docs.groupBy(*keys).agg(F.sum(line_count("value")).alias("loc"), F.sum(F.length("value")).alias("chars"))


def configured_sizes(entities: DataFrame, docs: DataFrame, key: str, files: str) -> DataFrame:
    """key, loc, chars over the listed files that exist; nulls where none does."""
    listed = entities.select(key, F.explode_outer(files).alias("path")).join(docs, "path", "left")
    return sizes(listed, key)


def first_candidates(entities: DataFrame, docs: DataFrame, key: str, candidates: str) -> DataFrame:
    """key, path, value: for each key the first of its candidate paths that exists."""
    ranked = entities.select(key, F.posexplode(candidates).alias("_p", "path")).join(docs, "path")
    return ranked.groupBy(key).agg(F.min_by(F.struct("path", "value"), "_p").alias("_v")).select(key, "_v.path", "_v.value")


def first_named(docs: DataFrame, root: str, names: Sequence[str]) -> DataFrame:
    """root, path: in each root, a direct file of the first name that exists, else the first in order anywhere below."""
    inside = F.expr(f"substring(path, length({root}) + 2)")
    named = docs.where(base_name("path").isin(*names)).withColumn("_direct", ~inside.contains("/"))
    rank = F.array_position(F.array(*map(F.lit, names)), base_name("path"))
    return named.groupBy(root).agg(F.min_by("path", F.struct(~F.col("_direct"), F.when(F.col("_direct"), rank).otherwise(0), "path")).alias("path"))


def stage_logs(stages: DataFrame, docs: DataFrame, experiment_dir: str, root: str) -> DataFrame:
    """stages with log: stderr, then stdout, each found under the root or else under the experiment's folder; equi-joins only."""
    out = stages
    for side in ("stderr", "stdout"):
        for number, folder in enumerate((F.lit(root), F.col(experiment_dir))):
            full = F.when(F.col(f"{side}_log").startswith("/"), F.col(f"{side}_log")).otherwise(F.concat_ws("/", folder, f"{side}_log"))
            files = docs.select(F.col("path").alias(f"_{side}_path{number}"), F.col("value").alias(f"_{side}{number}"))
            out = out.withColumn(f"_{side}_path{number}", full).join(files, f"_{side}_path{number}", "left").drop(f"_{side}_path{number}")
    log = F.nullif(F.concat_ws("\n", F.coalesce("_stderr0", "_stderr1"), F.coalesce("_stdout0", "_stdout1")), F.lit(""))
    return out.withColumn("log", log).drop("_stderr0", "_stderr1", "_stdout0", "_stdout1")


def _headers(docs: DataFrame) -> DataFrame:
    return docs.where(has_suffix("path") & ~F.exists(F.split("path", "/"), lambda p: p.isin(*LEFT_OUT)))


def class_index(docs: DataFrame) -> DataFrame:
    """name, files: where each class or struct is declared."""
    return _headers(docs).select("path", F.explode(F.array_distinct(class_declarations("value"))).alias("name")).groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("files"))


def test_index(docs: DataFrame) -> DataFrame:
    """suite, tests: 'suite.test' of each declaration."""
    found = _headers(docs).select(F.explode(test_declarations("value")).alias("t"))
    return found.groupBy("t.suite").agg(F.array_sort(F.collect_set(F.concat_ws(".", "t.suite", "t.test"))).alias("tests"))


def file_info(expected: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """expected (role, path) with exists, bytes, lines, sha256; files of over 2 GB are beyond the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), line_count(F.decode("content", "UTF-8")).alias("lines"))
    return expected.join(files, "path", "left").withColumn("exists", F.col("sha256").isNotNull())


def repositories(entries: DataFrame) -> DataFrame:
    """An inventory of folders; those that aren't under version control get placeholders."""
    known = F.coalesce(F.col("is_git"), F.lit(False))
    return entries.select("repository_id", "local_path", *(F.when(known, F.col(c)).otherwise("NOT_A_GIT_REPOSITORY").alias(c) for c in ("origin_url", "commit")))

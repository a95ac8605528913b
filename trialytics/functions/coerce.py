"""Tolerant coercions and fallbacks over columns. Null, '' and [] are empty; 0 and false are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings.
TRUE_WORDS = ("true", "yes", "1", "pass", "passed", "success")
FALSE_WORDS = ("false", "no", "0", "fail", "failed", "error")
PASSED_WORDS = ("pass", "passed", "success", "successful", "ok", "complete", "completed")
FAILED_WORDS = ("fail", "failed", "failure", "error", "timed_out", "timeout", "hung")
SKIPPED_WORDS = ("skip", "skipped", "not_run", "not_executed")
UNKNOWN_WORDS = ("unknown", "pending", "ready", "disabled")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _numeric(x: Column) -> Column:
    """Whether the column's type is a number's; known when the plan is made."""
    return F.typeof(x).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")


def nonempty(x: Column | str) -> Column:
    """A string, or null where it is empty."""
    return F.nullif(_c(x), F.lit(""))


def nonempty_array(x: Column | str) -> Column:
    return F.when(F.size(_c(x)) > 0, _c(x))


def first_nonempty(*xs: Column | str) -> Column:
    """The first string that isn't null or empty."""
    return F.coalesce(*map(nonempty, xs))


def coerce_bool(x: Column | str) -> Column:
    """Three-valued truth: booleans, numbers that equal 1 or 0, and spellings; null for any other."""
    word = F.lower(F.trim(_c(x).cast("string")))
    number = F.when(_numeric(_c(x)), word.try_cast("double"))
    return F.when(word.isin(*TRUE_WORDS) | (number == 1), True).when(word.isin(*FALSE_WORDS) | (number == 0), False)


def coerce_int(x: Column | str) -> Column:
    """Whole number of a text, in which single underscores between digits are allowed and a decimal point isn't; of a number, toward zero (null for NaN and infinities); of a boolean, 1 or 0."""
    text = F.trim(_c(x).cast("string"))
    whole = F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(text, "_", "").try_cast("bigint"))
    value = text.try_cast("double")
    cut = F.when(~F.isnan(value) & (F.abs(value) < float(1 << 63)), value.try_cast("bigint"))
    boolean = F.when(F.typeof(_c(x)) == "boolean", F.when(text == "true", 1).when(text == "false", 0))
    return F.coalesce(whole, F.when(_numeric(_c(x)), cut), boolean.cast("bigint"))


def truncate_int(x: Column | str) -> Column:
    """Whole number of a double, toward zero; null for NaN and infinities."""
    value = _c(x).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float(1 << 63)), value.try_cast("bigint"))


def coerce_float(x: Column | str) -> Column:
    return F.trim(_c(x).cast("string")).try_cast("double")


def normalize_status(x: Column | str) -> Column:
    """passed, failed, skipped or unknown; null for any other word. Booleans count as passed and failed."""
    word = F.regexp_replace(F.lower(F.trim(_c(x).cast("string"))), " ", "_")
    return (
        F.when(word.isin("true", *PASSED_WORDS), "passed")
        .when(word.isin("false", *FAILED_WORDS), "failed")
        .when(word.isin(*SKIPPED_WORDS), "skipped")
        .when(word.isin(*UNKNOWN_WORDS), "unknown")
    )


def stage_status(skipped: Column, passed: Column, status: Column, present: Column) -> Column:
    """Status of a stage object: skipped, then the passed flag, then the status word, then unknown; not_recorded without an object."""
    return (
        F.when(~F.coalesce(present, F.lit(False)), "not_recorded")
        .when(F.coalesce(skipped, F.lit(False)), "skipped")
        .when(passed, "passed")
        .when(~passed, "failed")
        .otherwise(F.coalesce(normalize_status(status), F.lit("unknown")))
    )


def generation_status(present: Column, done_reason: Column, error: Column | None = None) -> Column:
    """Status of a generation by its done reason."""
    reason = F.lower(F.trim(done_reason))
    failed = (reason == "length") if error is None else (reason == "length") | nonempty(error).isNotNull()
    return (
        F.when(~F.coalesce(present, F.lit(False)), "not_recorded")
        .when(F.coalesce(failed, F.lit(False)), "failed")
        .when(reason.isin("stop", "complete", "completed", "success"), "passed")
        .otherwise("unknown")
    )


def overall_ladder(evaluation: Column, batch: Column, run: Column, full_test: Column, any_failure: Column) -> Column:
    """Outcome by the first source that has one; then a passed full test, then any failure, else unknown."""
    return F.coalesce(evaluation, batch, run, F.when(full_test == "passed", True).when(any_failure, False))


def variant_path(variant: Column | str, *paths: str, kind: str = "string") -> Column:
    """The value at the first of the paths that exists, even if it is a JSON null. Only objects are walked."""
    out = F.lit(None).cast(kind)
    for path in reversed(paths):
        at = F.try_variant_get(_c(variant), "$." + path, "variant")
        out = F.when(at.isNotNull(), F.try_variant_get(_c(variant), "$." + path, kind)).otherwise(out)
    return out


def nested_default(variant: Column | str, path: str, default: Column, kind: str = "string") -> Column:
    return F.coalesce(F.try_variant_get(_c(variant), "$." + path, kind), default)


def bool_label(x: Column | str) -> Column:
    return F.when(_c(x), "PASS").when(~_c(x), "FAIL").otherwise("N/A")


def yes_no(x: Column | str) -> Column:
    return F.when(_c(x), "はい").when(~_c(x), "いいえ").otherwise("不明")


def result_label(x: Column | str) -> Column:
    """PASS only for true."""
    return F.when(F.coalesce(_c(x), F.lit(False)), "PASS").otherwise("FAIL")


def repository_of(target_id: Column | str, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Repository by (prefix, repository), else the text before the first hyphen."""
    out = F.substring_index(_c(target_id), "-", 1)
    for prefix, repository in reversed(prefixes):
        out = F.when(_c(target_id).startswith(prefix), repository).otherwise(out)
    return out


def name_of(target_id: Column | str, prefixes: Sequence[str]) -> Column:
    """The id without its prefix, hyphens as underscores."""
    out = _c(target_id)
    for prefix in reversed(prefixes):
        out = F.when(_c(target_id).startswith(prefix), F.substring(_c(target_id), len(prefix) + 1, 1 << 30)).otherwise(out)
    return F.replace(out, F.lit("-"), F.lit("_"))


def response_text(doc: Column | str) -> Column:
    """The reply's text at the first of the places that exists; null unless it is a string that isn't blank."""
    paths = ("response", "content", "message.content", "choices['0'].message.content", "choices['0'].text")  # fixed values
    found = variant_path(doc, *paths, kind="variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.try_variant_get(found, "$", "string"), F.lit(""))).try_cast("string")


# What is told of a model, and of its options.
MODEL_FIELDS = ("name", "local_id", "architecture", "parameters", "quantization", "ollama_version")
OPTION_FIELDS = ("temperature", "seed", "num_ctx", "num_predict", "top_k", "top_p", "repeat_penalty")


def model_of(run: Column | str) -> Column:
    """struct of the fourteen strings that a run's configuration tells of its model; nulls for what it doesn't."""
    at = lambda path: F.try_variant_get(_c(run), path, "string")
    return F.struct(at("$.provider").alias("provider"), *(at(f"$.model.{n}").alias(n) for n in MODEL_FIELDS), *(at(f"$.generation.options.{n}").alias(n) for n in OPTION_FIELDS))


def exchange(request: Column | str, response: Column | str) -> Column:
    """struct(model, stream, system_chars, prompt_chars, response_chars) of a request and its response; lengths of strings only."""

    def string(doc: Column | str, name: str) -> Column:
        value = F.try_variant_get(_c(doc), f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    sizes = [F.length(string(d, n)).cast("bigint").alias(f"{n}_chars") for d, n in ((request, "system"), (request, "prompt"), (response, "response"))]
    return F.struct(first_nonempty(string(request, "model"), string(response, "model")).alias("model"), F.try_variant_get(_c(request), "$.stream", "boolean").alias("stream"), *sizes)


def file_map(text: Column | str, schema: str) -> Column:
    """path -> content of a reply's files, the last of a path; null where it isn't such an object."""
    parsed = F.from_json(_c(text), schema)["files"]
    usable = F.size(parsed) == F.size(F.filter(parsed, lambda f: f["path"].isNotNull() & f["content"].isNotNull()))
    paths = F.array_distinct(F.transform(parsed, lambda f: f["path"]))
    last = F.transform(paths, lambda p: F.struct(p.alias("k"), F.try_element_at(F.filter(parsed, lambda f: f["path"] == p), F.lit(-1))["content"].alias("v")))
    return F.when(usable, F.map_from_entries(last))

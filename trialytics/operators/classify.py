"""Failure classification: an ordered rule chain, as one CASE expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialytics.functions.text import first_error_line

# Patterns over lower-cased compiler output, in order of precedence.
BUILD_RULES = (
    ("syntax_error", r"stray .* in program|expected .* before|expected .* after|expected primary-expression|expected declaration|unterminated|syntax error"),
    ("duplicate_definition", r"redefinition|multiple definition"),
    ("missing_definition_or_dependency", r"undefined reference|no such file or directory|cannot find -l|has not been declared|was not declared in this scope|not declared in this scope|not found"),
    ("type_interface_misunderstanding", r"request for member.*non-class type|has no member|no member named|no matching function|cannot convert|invalid conversion|conflicting types|invalid use of|incomplete type|no declaration matches"),
    ("timeout_or_hang", r"timed out|timeout|killed|terminated|hang"),
)
ERROR_LINES = (r"fatal error|error:|undefined reference|Assertion.*failed|FAILED|Traceback", r"timed out|timeout|hung|killed|terminated")
# Failure categories and what reports call them.
ENDED_SHORT = {"design_generation": "design generation ended with done_reason=length", "code_regeneration": "code regeneration ended with done_reason=length"}
LABELS = {
    "none": "成功",
    "output_truncation": "生成出力の打ち切り",
    "output_format_or_pipeline": "出力形式・パイプライン失敗",
    "timeout_or_hang": "タイムアウト・停止",
    "hang_external_stop_deadlock_suspected": "ハング・外部停止（デッドロック疑い）",
    "configure_failure": "configure失敗",
    "syntax_error": "構文エラー",
    "type_interface_misunderstanding": "型・インタフェースの誤理解",
    "missing_definition_or_dependency": "定義・依存関係の欠落",
    "duplicate_definition": "重複定義",
    "build_failure_other": "その他のビルド失敗",
    "direct_test_failure": "直接テスト失敗",
    "full_test_failure": "全体テスト失敗",
    "unknown_failure": "原因未分類",
}


def label(category: Column | str) -> Column:
    """What reports call a category; an unknown one as it is."""
    x = F.col(category) if isinstance(category, str) else category
    return F.coalesce(*(F.when(x == code, F.lit(name)) for code, name in LABELS.items()), x)



def build_category(text: Column) -> Column:
    out = F.lit("build_failure_other")
    for category, pattern in reversed(BUILD_RULES):
        out = F.when(text.rlike(pattern), category).otherwise(out)
    return out


def classify(row: Mapping[str, Column], order: tuple[str, ...], log: Column, stopped: Column | None = None, stopped_words: Column | None = None) -> Column:
    """struct(stage, category, detail) of a record.

    row: overall_pass, design_reason, code_reason, failure_present, failure_stage,
    failure_message, detail, and for each stage of order <stage>_status, <stage>_timed_out,
    <stage>_exit, <stage>_ran (any count); where there are, told_stage (of other sources) and
    direct_test_elapsed. log: the failing stage's text. stopped, stopped_words: the category and
    text of a direct test that was stopped from outside before it counted anything (null:
    timeout_or_hang). The error line is looked for once, and only in rows that didn't pass.
    """
    none = F.lit(None).cast("string")
    failed = lambda s: row[f"{s}_status"] == "failed"
    timed = F.coalesce(*(F.when(row[f"{s}_timed_out"], s) for s in order))
    message = F.coalesce(row["failure_message"], F.lit(""))
    words = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    hung = F.coalesce(row["direct_test_exit"].isin(124, 137, 143) & row["direct_test_ran"].isNull(), F.lit(False))
    ended = F.concat(F.lit("direct_test terminated before test counts were recorded (exit_code="), words(row["direct_test_exit"]), F.lit(", elapsed_seconds="), words(row.get("direct_test_elapsed", none)), F.lit(")"))
    hung_as = F.coalesce(none if stopped is None else stopped, F.lit("timeout_or_hang"))
    hung_words = F.coalesce(none if stopped_words is None else stopped_words, ended)

    def result(stage: Column | str, category: Column | str, detail: Column | str) -> Column:
        of = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(of(stage).alias("stage"), of(category).alias("category"), of(detail).alias("detail"))

    def rules(found: Column) -> Column:
        error, text = found["error"], found["text"]
        truncated = message.rlike("(?i)length|truncat|token limit|incomplete")
        stuck = F.coalesce(row["detail"], F.lit("")).rlike("(?i)timeout|hung|stopp")
        return (
            F.when(row["overall_pass"], result(none, "none", none))
            .when(timed.isNotNull(), result(timed, "timeout_or_hang", F.coalesce(error, F.concat(timed, F.lit(" timed out")))))
            .when(row["design_reason"] == "length", result("design_generation", "output_truncation", ENDED_SHORT["design_generation"]))
            .when(row["code_reason"] == "length", result("code_regeneration", "output_truncation", ENDED_SHORT["code_regeneration"]))
            .when(row["failure_present"], result(F.coalesce(row["failure_stage"], F.lit("pipeline")), F.when(truncated, "output_truncation").otherwise("output_format_or_pipeline"), F.left(message, F.lit(500))))
            .when(failed("configure"), result("configure", "configure_failure", error))
            .when(failed("build"), result("build", build_category(text), error))
            .when(failed("direct_test"), result("direct_test", F.when(hung, hung_as).otherwise("direct_test_failure"), F.when(hung, F.coalesce(error, hung_words)).otherwise(error)))
            .when(failed("full_test"), result("full_test", "full_test_failure", error))
            .otherwise(result(F.coalesce(row.get("told_stage", row["failure_stage"]), F.lit("unknown")), F.when(stuck, "timeout_or_hang").otherwise("unknown_failure"), row["detail"]))
        )

    # arrays of one: a lambda's argument is worked out once, however often the rules name it
    line = F.when(~F.coalesce(row["overall_pass"], F.lit(False)), F.nullif(first_error_line(log, ERROR_LINES), F.lit("")))
    both = F.transform(F.array(line), lambda e: F.struct(e.alias("error"), F.lower(F.coalesce(e, F.left(F.coalesce(log, F.lit("")), F.lit(5000)))).alias("text")))
    return F.get(F.transform(both, rules), F.lit(0))

"""One overview for each experiment: conditions, files, exchanges with the model, stages, comparison of code.

All experiments of a table of artefacts are worked out together, a row each; a report of one
of them is then written from its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialytics.functions import coerce, fmt, text
from trialytics.plans.study import EXPERIMENTS, folders
from trialytics.sinks import reports
from trialytics.udf.similarity import compare

# Documents of an experiment; files and what they are for; titles of the exchanges and stages.
DOCUMENTS = {
    "source": "input/source_metadata.json", "run": "configs/run_config.json", "design": "raw_output/design_generation_metadata.json", "code": "raw_output/code_regeneration_metadata.json", "manifest": "evaluation/evaluation_manifest.json", "replacement": "evaluation/source_replacement.json",
    "built": "evaluation/build_result.json", "direct": "evaluation/direct_test_result.json", "full": "evaluation/full_test_result.json", "ctest": "evaluation/ctest_result.json",
    "design_request": "raw_output/design_generation_request.json", "design_response": "raw_output/design_generation_response.json", "code_request": "raw_output/code_regeneration_request.json",
    "code_response": "raw_output/code_regeneration_response.json",
}
ORIGINAL, REGENERATED = "backup/original_write_body.cpp", "generated/regenerated_write_body.cpp"
INPUTS = (
    ("設計書生成へ与えた元コード", "input/design_input.cpp"), ("コード再生成時の固定スキャフォールド", "input/fixed_scaffold.cpp"), ("コード再生成時の依存関係情報", "input/dependency_context.txt"), ("設計書生成プロンプト", "prompts/design_generation_prompt.md"), ("コード再生成プロンプト", "prompts/code_regeneration_prompt.md"), ("モデル・生成パラメータ", DOCUMENTS["run"]),
)
OUTPUTS = (
    ("LLMが生成した設計文書", "generated/design_document.md"), ("設計文書から再生成した関数本体", REGENERATED), ("設計書生成APIリクエスト", DOCUMENTS["design_request"]), ("設計書生成API応答", DOCUMENTS["design_response"]), ("コード再生成APIリクエスト", DOCUMENTS["code_request"]), ("コード再生成API応答", DOCUMENTS["code_response"]),
    ("評価結果の機械可読マニフェスト", DOCUMENTS["manifest"]), ("評価結果の要約", "evaluation/evaluation_summary.md"), ("一時置換した差分", "evaluation/replacement_diff.patch"),
)
GENERATIONS = {"design": "設計書生成", "code": "コード再生成"}
CLEAN = "追跡対象の差分・変更がないことを確認"


def file_roles(docs: DataFrame, experiments: DataFrame) -> DataFrame:
    """experiment, inputs, outputs: every expected file with its role, and its size, lines and digest where it is there."""
    roles = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(no).alias("no"), F.lit(role).alias("role"), F.lit(rel).alias("rel")) for side, listed in (("inputs", INPUTS), ("outputs", OUTPUTS)) for no, (role, rel) in enumerate(listed)))
    expected = experiments.select("experiment", F.explode(roles).alias("r")).select("experiment", "r.*").withColumn("path", F.concat_ws("/", F.lit(EXPERIMENTS), "experiment", "rel"))
    found = expected.join(docs, "path", "left")
    info = F.struct("no", "role", "path", F.col("bytes").isNotNull().alias("exists"), F.col("bytes").alias("size_bytes"), text.line_count("value").alias("line_count"), "sha256")
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, info))), lambda x: x.dropFields("no")).alias(s)
    return found.groupBy("experiment").agg(side("inputs"), side("outputs"))


def overviews(docs: DataFrame) -> DataFrame:
    """A row for each experiment (docs: path, value, bytes, sha256). Missing and unreadable documents count as empty."""
    below = folders(docs.select("path")).where(F.col("dir").rlike(f"^{EXPERIMENTS}/[^/]+$")).withColumn("experiment", F.substring_index("dir", "/", -1))
    held = below.join(docs, "path")
    text_of = lambda rel: F.max(F.when((F.col("rel") == rel) & (F.col("readable") | ~F.col("rel").endswith(".json")), F.col("value")))
    gathered = held.groupBy("experiment").agg(*(text_of(rel).alias(f"_{n}") for n, rel in DOCUMENTS.items()), text_of(ORIGINAL).alias("_original"), text_of(REGENERATED).alias("_regenerated"),
        *(F.max(F.when(F.col("rel") == rel, F.col("sha256"))).alias(n) for n, rel in (("_original_sha256", ORIGINAL), ("_regenerated_sha256", REGENERATED))))

    def document(name: str) -> Column:
        doc = F.try_parse_json(f"_{name}")
        return F.when(F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), doc).otherwise(F.parse_json(F.lit("{}")))

    rows = gathered.withColumns({n: document(n) for n in DOCUMENTS}).join(file_roles(docs, gathered.select("experiment")), "experiment")
    at = lambda doc, path, kind="string": F.try_variant_get(doc, f"$.{path}", kind)
    said = lambda doc, path, absent="N/A": F.coalesce(at(doc, path), F.lit(absent))
    tests = {}
    for name in ("direct", "full"):
        ran, ok, bad = (at(name, f"gtest.tests_{n}", "bigint") for n in ("ran", "passed", "failed"))
        tests[name] = F.struct(ran.alias("ran"), ok.alias("passed"), bad.alias("failed"), at(name, "expected_tests", "bigint").alias("expected"))

    def stage(name: str, passed: Column, detail: Column, seconds: Column | None = None) -> Column:
        elapsed = F.lit(None).cast("double") if seconds is None else seconds
        return F.struct(F.lit(name).alias("name"), passed.alias("passed"), coerce.bool_label(passed).alias("status"), detail.alias("detail"), elapsed.alias("elapsed_seconds"))

    def of_tests(name: str) -> Column:
        count = F.coalesce(at(name, "expected_tests"), at(name, "gtest.tests_ran"), F.lit("None"))
        return F.concat(said(name, "gtest.tests_passed", "None"), F.lit("/"), count, F.lit(" passed"))

    tokens = lambda doc: F.concat(F.lit("入力"), said(doc, "prompt_eval_count"), F.lit(" tokens，出力"), said(doc, "eval_count"), F.lit(" tokens"))
    code_of = lambda doc, path="exit_code": F.concat(F.lit("exit code "), said(doc, path))
    seconds = lambda doc, path="elapsed_seconds": at(doc, path, "double")
    stages = F.array(
        *(stage(title, F.coalesce(at(doc, "done", "boolean"), F.lit(False)), tokens(doc), seconds(doc)) for doc, title in GENERATIONS.items()),
        stage("clean configure", at("built", "configure.passed", "boolean"), code_of("built", "configure.exit_code"), seconds("built", "configure.elapsed_seconds")),
        stage("full build", at("built", "build.passed", "boolean"), code_of("built", "build.exit_code"), seconds("built", "build.elapsed_seconds")),
        stage("直接テスト", at("direct", "passed", "boolean"), of_tests("direct"), seconds("direct")),
        stage("全GoogleTest", at("full", "passed", "boolean"), of_tests("full"), seconds("full")),
        stage("CTest", at("ctest", "passed", "boolean"), code_of("ctest"), seconds("ctest")),
        stage("元コード復元", at("manifest", "restoration.restored", "boolean"), F.concat(F.lit("SHA-256 "), said("manifest", "restoration.restored_sha256"))),
        stage("submodule clean", at("manifest", "restoration.submodule_clean", "boolean"), F.lit(CLEAN)),
    )
    total = lambda *xs: F.aggregate(F.array_compact(F.array(*xs)), F.lit(0.0), lambda s, x: s + x)
    one, two = text.normalized_text("_original"), text.normalized_text("_regenerated")
    both = compare(one, two)
    there = one.isNotNull() & two.isNotNull()
    comparison = F.struct(there.alias("available"), both["exact"].alias("exact_match"), both["ignoring_space"].alias("whitespace_insensitive_match"), both["similarity"].alias("similarity_ratio"),
        F.when(there, text.line_count(one)).alias("original_lines"), F.when(there, text.line_count(two)).alias("regenerated_lines"), F.when(there, F.col("_original_sha256")).alias("original_sha256"),
        F.when(there, F.col("_regenerated_sha256")).alias("regenerated_sha256"))
    path = lambda rel: F.concat_ws("/", F.lit(EXPERIMENTS), "experiment", F.lit(rel))
    string = lambda doc, name: F.when(F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")) == "STRING", at(doc, name)).otherwise("")

    def traffic(kind: str) -> Column:
        told, ask, reply = coerce.exchange(f"{kind}_request", f"{kind}_response"), f"{kind}_request", f"{kind}_response"
        return F.struct(F.lit(GENERATIONS[kind]).alias("stage"), path(DOCUMENTS[ask]).alias("request_path"), path(DOCUMENTS[reply]).alias("response_path"),
            *(told[n].alias(n) for n in ("model", "stream", "system_chars", "prompt_chars", "response_chars")), string(ask, "system").alias("system"), string(ask, "prompt").alias("prompt"),
            string(reply, "response").alias("response_text"))

    rows = rows.withColumn("stages", stages)
    return rows.select(
        "experiment", F.coalesce(at("manifest", "experiment_id"), at("run", "experiment_id"), F.col("experiment")).alias("experiment_id"), F.coalesce(at("manifest", "run_id"), at("run", "run_id")).alias("run_id"),
        *(at("source", k).alias(n) for n, k in (("repository", "repository"), ("repository_commit", "repository_commit"), ("submodule_commit", "submodule_commit"), ("target_name", "target_function"), ("target_granularity", "target_granularity"), ("source_file", "source_file"))),
        coerce.model_of("run").alias("model"), at("manifest", "overall_pass", "boolean").alias("overall_pass"),
        F.size(F.filter("stages", lambda s: s["passed"])).alias("stage_passed"), F.size(F.filter("stages", lambda s: s["passed"].isNotNull())).alias("stage_total"), tests["direct"].alias("direct_tests"), tests["full"].alias("full_tests"),
        total(seconds("design"), seconds("code")).alias("generation_total_seconds"), total(seconds("built", "configure.elapsed_seconds"), seconds("built", "build.elapsed_seconds"), seconds("direct"), seconds("full"), seconds("ctest")).alias("evaluation_total_seconds"),
        F.struct(
            *(said("source", k).alias(k) for k in ("target_class", "original_function_body_included_for_design_generation", "original_function_body_excluded_from_regeneration_input", "replacement_scope")),
            F.coalesce(F.nullif(F.array_join(at("source", "dependency_methods", "array<string>"), ", "), F.lit("")), F.lit("N/A")).alias("dependency_methods"),
            *(said("run", f"conditions.{k}").alias(k) for k in ("retry_on_failure", "automatic_repair")),
            F.transform("stages", lambda s: F.coalesce(fmt.duration(s["elapsed_seconds"]), F.lit("N/A"))).alias("stage_seconds"),
            fmt.duration(total(seconds("design"), seconds("code"))).alias("generation"), fmt.duration(total(seconds("built", "configure.elapsed_seconds"), seconds("built", "build.elapsed_seconds"), seconds("direct"), seconds("full"), seconds("ctest"))).alias("evaluation"),
        ).alias("facts"),
        "inputs", "outputs", "stages", F.array(*map(traffic, GENERATIONS)).alias("llm_input_output"), comparison.alias("code_comparison"), F.to_json("replacement").alias("source_replacement"),
    )


# The report's title, its sections in order, and what its tables call their columns and rows.
TITLE = "# ラウンドトリップ実験 総合レポート"
SECTIONS = (
    "一目で分かる結果", "実験のデータフロー", "対象と入力条件", "LLM実行条件", "入力ファイル", "生成物・評価成果物", "各工程の評価", "LLMへ送信した入力と返却された出力", "元コードと再生成コードのテキスト比較", "評価の解釈", "内容確認", "再現性のための主要ファイル",
)
ITEM = ("項目", "値")
FLOW_COLUMNS = ("段階", "主な入力", "主な出力", "結果")
FILE_COLUMNS = ("役割", "パス", "行数", "サイズ", "SHA-256")
STAGE_COLUMNS = ("工程", "結果", "詳細", "時間")
EXCHANGE_COLUMNS = ("段階", "モデル", "system文字数", "prompt文字数", "出力文字数")
MISSING, YES, NO = "欠落", "はい", "いいえ"
MODEL_ROWS = (("Provider", "provider"), ("Model", "name"), ("Local model ID", "local_id"), ("Architecture", "architecture"), ("Parameters", "parameters"), ("Quantization", "quantization"),
    ("Ollama", "ollama_version"), *((n, n) for n in ("temperature", "seed", "num_ctx", "num_predict", "top_k", "top_p", "repeat_penalty")))
COMPARED = (("完全一致", "exact_match"), ("空白を除いた一致", "whitespace_insensitive_match"), ("文字列類似度", "similarity_ratio"), ("元コード行数", "original_lines"), ("再生成コード行数", "regenerated_lines"), ("元コードSHA-256", "original_sha256"), ("再生成コードSHA-256", "regenerated_sha256"))


def report(row: dict, contents: dict[str, str]) -> str:
    """The overview of an experiment in Markdown, in SECTIONS; the texts are our own. contents: texts to show in full, by path; without any, exchanges and contents are left out."""
    cell = lambda v: "—" if v in (None, "") else str(v).replace("|", "\\|").replace("\n", " ")
    grid = lambda heads, lines: "\n".join("| " + " | ".join(map(cell, x)) + " |" for x in [heads, ["---"] * len(heads), *lines])
    code = lambda v: f"`{v if v is not None else 'N/A'}`"
    label = lambda v: {True: "PASS", False: "FAIL"}.get(v, "N/A")
    shown = lambda v: {True: YES, False: NO, "true": YES, "false": NO}.get(v, "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else v)
    counts = lambda t: "N/A" if t["passed"] is None else f"{t['passed']}/{t['expected'] if t['expected'] is not None else t['ran']}"
    files = lambda listed: grid(FILE_COLUMNS, [[f["role"], code(f["path"]), *((f[n] if f["exists"] else MISSING) for n in ("line_count", "size_bytes")), code(f["sha256"]) if f["sha256"] else "N/A"] for f in listed])
    facts, model, compared = row["facts"], row["model"], row["code_comparison"]
    there = {f["path"].split("/", 2)[-1] for f in [*row["inputs"], *row["outputs"]] if f["exists"]}
    names = lambda listed: ", ".join(code(n) for n in listed if n in there) or "N/A"
    target = [
        ("Repository", row["repository"]), ("Repository commit", code(row["repository_commit"])), ("GoogleTest commit", code(row["submodule_commit"])), ("対象クラス", facts["target_class"]), ("対象関数", row["target_name"]), ("置換粒度", row["target_granularity"]), ("ソース", code(row["source_file"])),
        ("設計生成時に元関数本体を含む", shown(facts["original_function_body_included_for_design_generation"])), ("コード再生成時に元関数本体を除外", shown(facts["original_function_body_excluded_from_regeneration_input"])), ("置換範囲", facts["replacement_scope"]), ("依存メソッド", facts["dependency_methods"]),
    ]
    first = [
        ("実験ID", code(row["experiment_id"])), ("実行ID", code(row["run_id"])), ("対象", code(row["target_name"])), ("粒度", code(row["target_granularity"])), ("モデル", code(model["name"])), ("総合判定", f"**{label(row['overall_pass'])}**"),
        ("評価工程", f"{row['stage_passed']}/{row['stage_total']} PASS"), ("直接テスト", f"{counts(row['direct_tests'])} PASS"), ("全GoogleTest", f"{counts(row['full_tests'])} PASS"), ("生成処理時間", facts["generation"]), ("評価処理時間", facts["evaluation"]),
    ]
    flow = [
        ("元コード → 設計文書", names(["input/design_input.cpp", "prompts/design_generation_prompt.md"]), names(["generated/design_document.md"]), row["stages"][0]["status"]),
        ("設計文書 → コード", names(["generated/design_document.md", "input/fixed_scaffold.cpp", "input/dependency_context.txt"]), names([REGENERATED]), row["stages"][1]["status"]),
        ("再生成コード → 評価", names([REGENERATED]), names([DOCUMENTS["manifest"], "evaluation/evaluation_summary.md", "evaluation/replacement_diff.patch"]), label(row["overall_pass"])),
    ]
    exchanges = [grid(EXCHANGE_COLUMNS, [[x["stage"], code(x["model"]), x["system_chars"], x["prompt_chars"], x["response_chars"]] for x in row["llm_input_output"]])]
    for x in row["llm_input_output"] if contents else ():
        kinds = (("system", "system", "text"), ("prompt", "prompt", "text"), ("response", "response_text", "markdown" if x["stage"] == GENERATIONS["design"] else "cpp"), ("request JSON", "request_json", "json"), ("response JSON", "response_json", "json"))
        exchanges.append(f"### {x['stage']}\n\n" + "\n".join(reports.collapsible(f"{x['stage']}: {title}", x[name], language) for title, name, language in kinds if x.get(name)))
    verdict = {True: "Every recorded stage passed.", False: "At least one stage did not pass."}.get(row["overall_pass"], "There is no overall result.")
    bodies = (
        grid(ITEM, first), grid(FLOW_COLUMNS, flow), grid(ITEM, target), grid(ITEM, [*((title, model.get(name)) for title, name in MODEL_ROWS), ("再試行", shown(facts["retry_on_failure"])), ("自動修正", shown(facts["automatic_repair"]))]),
        files(row["inputs"]), files(row["outputs"]), grid(STAGE_COLUMNS, [[s["name"], s["status"], s["detail"], seconds] for s, seconds in zip(row["stages"], facts["stage_seconds"], strict=True)]), "\n\n".join(exchanges),
        grid(ITEM, [(title, code(compared[name]) if name.endswith("sha256") else shown(compared[name])) for title, name in COMPARED]) if compared["available"] else "Files to compare are missing.", f"{verdict} Tests speak for what they cover.",
        "\n".join(reports.collapsible(p, t) for p, t in contents.items()), "\n".join(f"- {f['role']}: {code(f['path'])}" for f in [*row["inputs"], *row["outputs"]] if f["exists"]),
    )
    made = [f"## {i}. {title}\n\n{body}" for i, (title, body) in enumerate(zip(SECTIONS, bodies, strict=True), 1) if contents or title != "内容確認"]
    return "\n\n".join([TITLE, *made]) + "\n"

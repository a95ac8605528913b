"""The queries over the test tables that __spark_entry__ registers for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.suffixdedup import remove_repeats

    return remove_repeats(read(spark, folder, "documents"), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.packing import pack_sequences

    return pack_sequences(read(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), 2048)


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.fingerprints import compare_with_edits

    return compare_with_edits(read(spark, folder, "documents"))


def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.bitsliced import top_k

    return top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.neardedup import near_groups

    return near_groups(read(spark, folder, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.tokens import count_tokens

    return count_tokens(read(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.linededup import dedup_lines

    done = dedup_lines(read(spark, folder, "documents"), 50)
    return done.select("doc_id", F.col("_w_lines").alias("n_lines"), F.col("_w_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.toxicity import held_out, score, train

    docs = read(spark, folder, "documents")
    model = train(docs, read(spark, folder, "labels"), ~held_out())
    done = score(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out().alias("held_out"), F.col("_t_score").alias("score"), F.col("_t_predicted").alias("predicted"), F.col("_t_offending").alias("offending"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.warc import round_trip

    return round_trip(read(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Target shares of the mixing query; numbers are temperatures.
MIX_TARGETS = {"source": 0.5, "lang": {"en": 0.5, "es": 0.2, "de": 0.15, "fr": 0.15}, "topic": 0.7}


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.mixing import calibrated

    mixed = calibrated(read(spark, folder, "documents"), MIX_TARGETS, 0.5)
    return mixed.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_probability", 9).alias("probability"), F.round("_weight", 9).alias("weight"), F.col("_kept").alias("kept"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.quality import verdicts

    return verdicts(read(spark, folder, "documents"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from trialytics.llm.alignment import align

    return align(read(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_fingerprints, op4_exact_topk, op5_minhash_dedup, op6_token_counts, op7_line_dedup, op8_toxicity, op9_warc, op10_mixing, op11_quality_rules, op12_alignment, pipeline)}

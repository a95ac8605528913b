"""The corpus pipeline: STAGES, applied in order by run().

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read again; what a
stage wrote on its way, and its predecessor's rows, are then deleted. A stage works on all that
its predecessor kept.

Nulls and edge cases are those of the operators; a stage over an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialytics.llm import linededup, toxicity
from trialytics.llm.common import free, own_names, written
from trialytics.llm.linededup import dedup_lines
from trialytics.llm.mixing import sample
from trialytics.llm.neardedup import near_groups, one_of_each
from trialytics.llm.packing import pack_sequences
from trialytics.llm.queries import MIX_TARGETS, tokenizer
from trialytics.llm.toxicity import held_out, score, train


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, learnt from the labels, scores below 0.5."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model).where(F.col(own_names(docs, toxicity.OWN)["_t_predicted"]) == 0).select(*docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of runs of lines of 50 words or more; n_chars follows the text."""
    done = dedup_lines(docs, 50)
    return done.withColumn("n_chars", F.when(F.col(own_names(docs, linededup.OWN)["_w_removed"]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that with the smallest id. Of rows with one id and one text one stays, and so of rows without an id; rows of one id with different texts all stay with their id."""
    return one_of_each(docs, near_groups(docs, words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled and repeated by calibrated weights: half of all tokens are expected, at the target shares. Scarce documents come more than once."""
    return sample(docs, MIX_TARGETS, 0.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_sequences(docs, tokenizer("word_bpe_49k.json"), 2048)


STAGES = [("toxicity", reject_toxic), ("line dedup", delete_repeated_lines), ("MinHash near-dedup", keep_one_of_near_copies), ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free(before)
    return docs

"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns documents, all columns kept; the last adds the tokens. ORACLE_SQL is None: the
first stage is a trained model, which SQL can't express; tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, decontaminate, langid, near, suffix
from larder.llm.common import fresh, materialize, tune

#: A document whose language is less certain than this goes.
CERTAIN = 0.5
#: Bytes of a string that repeats: a passage of over fifty words, even of short ones (four bytes with their space).
PASSAGE = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in no learned language for certain."""
    tune(spark)
    pred, score = fresh(docs, "__lang", "__score")
    said = langid.identify(docs, learn=~langid.held_out("doc_id"), pred=pred, score=score)
    return said.filter((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= CERTAIN)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of exact and near copies."""
    tune(spark)
    return near.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of PASSAGE bytes that occur more than once from the texts; documents stay."""
    tune(spark)
    return suffix.strip_repeats(docs, length=PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    tune(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds packed token ids, their number, and whether they decode to the text."""
    tune(spark)
    coded = bpe.tokenize(docs, text="text")
    return coded.withColumn("round_trip", bpe.decode(F.col("ids")) == F.coalesce(F.col("text"), F.lit("")).cast("binary"))


STAGES = [("language ID", identify_language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs

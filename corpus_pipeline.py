"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes what the one before kept.  ``run`` writes every stage as
Parquet in the shared folder and rereads it, so that a lost executor costs one
stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import bpe, decontaminate, minhash_dedup, pii, quality
from lexigrain.llm.shared import Workspace


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that most likely deserve the highest grade."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.rating())
    return quality.accepted(docs, model, least_grade=2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return minhash_dedup.keep_first_of_groups(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and disclosing terms generalised; n_chars follows the text."""
    return pii.sanitised(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and whether they decode to it again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, check_col="round_trip")
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: A trained model and a tokenizer can't be put as SQL; tests hold every stage and run() against plain Python loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs

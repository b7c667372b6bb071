"""Corpus pipeline over `documents`: quality rules, near duplicates, decontamination, personal data, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtloom.llm import bpe, decontamination, jaccard_join, pii, quality_rules
from courtloom.llm.queries import as_documents, as_narrations, ratings_of, references_of, text_session, tokenizer_path
from courtloom.session import scratch_path

#: The operators of the stages have no SQL form (learned rules, MinHash classes, tokenizer); tests compare with brute force.
ORACLE_SQL = None


def _narrations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text_session(spark)
    return as_narrations(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    narrations = _narrations(spark, docs)
    rules = quality_rules.fit_quality_rules(narrations, ratings_of(spark, sf_dir))
    return as_documents(quality_rules.kept_narrations(narrations, rules))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    narrations = _narrations(spark, docs)
    return as_documents(jaccard_join.one_per_class(narrations, jaccard_join.link_narrations(narrations)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return as_documents(decontamination.without_contaminated(_narrations(spark, docs), references_of(spark, sf_dir)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = as_documents(pii.redact(_narrations(spark, docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    coded = bpe.encode_narrations(_narrations(spark, docs).select("job_id", "summary"), tokenizer_path())
    return coded.select(F.col("job_id").alias("doc_id"), "codes.n_tokens", "codes.ids_sha256", "codes.decoded_sha256")


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("pii", personal_data), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each is written as Parquet in the shared folder and read again by the next."""
    docs, to = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    text_session(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{k}-{name}")
        docs = spark.read.parquet(f"{to}/{k}-{name}")
    return docs

"""Cleaning pipeline over ``documents``: language ID, near-duplicates, benchmark
passages, personal data, byte-level BPE round trip."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tierscope.llm import bpe, decontaminate, langid, ngram_join, pii  # noqa: E402
from tierscope.llm.common import DOC_COLUMNS, load, shared_folder  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter in it) go. With
    no labelled row to learn from, only those without a letter go."""
    model = langid.fit(docs)
    if not model.families:
        return docs.select(*DOC_COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs.select(*DOC_COLUMNS), model)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates stays."""
    return ngram_join.keep_one(docs.select(*DOC_COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents that are mostly benchmark text go."""
    return decontaminate.decontaminate(docs.select(*DOC_COLUMNS), load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows a changed text."""
    found = pii.replace(docs.select(*DOC_COLUMNS))
    n = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.withColumn("n_chars", n.otherwise(F.col("n_chars"))).select(*DOC_COLUMNS)


def token_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    import public_tokenizers
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("byte-level BPE", token_round_trip),
]

# Language ID and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's
    files go once the next stage's are written, the last stage's stay."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return docs

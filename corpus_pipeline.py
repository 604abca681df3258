"""The training-data pipeline: documents in, packed sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before has kept; all but the last return the columns of ``documents``:

1. language: rows whose language is unknown, or less likely than
   ``MIN_LANGUAGE_SCORE``, go; a null ``lang`` is filled with the prediction.
2. near_copies: of each group of near copies (five-word shingles, Jaccard 0.8
   or more, joined by links) the row with the smallest doc_id stays.
3. decontamination: rows that hold a ten-word window of a benchmark item go.
4. secrets: every found secret is replaced by a mark; ``n_chars`` follows.
5. packing: the texts, tokenised, cut and packed into windows of 2048 ids.

Null and empty texts have no language and go in stage 1; empty tables give
empty results.  Between stages rows are written as Parquet to the shared
folder, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from logvigil.llm.textkit import shared_dir

MIN_LANGUAGE_SCORE = 0.5
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80

#: SQL cannot express the trained language model, the secret battery and the
#: tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.in_fold("doc_id")))
    known = language_id.identify(docs, model, keep=tuple(docs.columns), lang_col="_lang",
                                 score_col="_score")
    return known.where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= MIN_LANGUAGE_SCORE)) \
        .withColumn("lang", F.coalesce("lang", "_lang")).drop("_lang", "_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_copies", near_copies), ("decontamination", decontamination),
    ("secrets", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs

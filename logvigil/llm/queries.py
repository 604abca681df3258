"""Registered queries of the subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.llm import (best_fit, decontaminate, html_extract, jaccard_join, language_id,
                          packing, periodic_runs, quality_rules, secret_scan, sharding,
                          suffix_dedup, url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query
def op8_sharding(spark, sf_dir):
    sharded = sharding.assign_shards(read(spark, sf_dir, "documents"), shards=24)
    return sharding.with_slots(sharded).withColumn("law", F.lit("key"))


@query
def op10_packing(spark, sf_dir):
    import public_tokenizers
    return packing.pack_documents(read(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark, sf_dir):
    found = jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op4_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


@query
def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_id.in_fold("doc_id"))
    return language_id.fit_predict(docs, keep=("doc_id", "held_out"))


@query
def op2_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.find_secrets(read(spark, sf_dir, "documents")))


@query
def op3_html_extract(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.fit(pages))


@query
def op6_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_filter.numbered_labels(pages, read(spark, sf_dir, "labels"))
    return url_filter.filter_urls(labelled, good="_good").select(
        "page_id", "host", "path", "rule", "verdict", "template")


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.word_runs(read(spark, sf_dir, "documents"), planted=True))


@query
def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op13_best_fit_packing(spark, sf_dir):
    import public_tokenizers
    return best_fit.pack_documents(read(spark, sf_dir, "documents"),
                                   public_tokenizers.path("word_bpe_49k.json"))

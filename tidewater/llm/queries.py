"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard_join, license_scan, mixing, packing, prefix_trie, quality, secret_scan, spotsigs, substring_dedup, suffix_dedup, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), n=13)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_long_repeats(_table(spark, sf_dir, "documents"), n=200)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, close=0)


@_query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(docs, weights=(3, 1, 2), share=1.5, limit=2.0).select("doc_id", "size", "source_size", "target", "copies", "taken")


ORACLE_SQL["op7_source_mixing"] = mixing.ORACLE


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.drop("text")


@_query
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("all")).alias("spans"))


@_query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents"), percent=80, n=5)


@_query
def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_and_next(_table(spark, sf_dir, "documents"))


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prefix_trie.nodes(prefix_trie.sequences(_table(spark, sf_dir, "conversations"), family=5, most=9))
    return got.withColumnRenamed("ends", "ends_sha256")


ORACLE_SQL["op11_prefix_trie"] = prefix_trie.ORACLE


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.encode(_table(spark, sf_dir, "embeddings"), "embedding", parts=4, entries=256, rounds=4)
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left")
    digest = F.sha2(F.lit(vector_codes.listed(codebooks)), 256)
    return joined.select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


ORACLE_SQL["op12_vector_codes"] = vector_codes.ORACLE


@_query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL["op13_decontamination"] = decontam.ORACLE

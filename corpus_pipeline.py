"""A training-data pipeline over documents, stage by stage.

Quality rules drop texts, the n-gram join keeps one document of each group of near duplicates, secrets are masked, sources are mixed to
their target weights (a document may then stand there more than once), and what is left is packed into sequences.

Every stage takes null and repeated ids, null, empty and very long texts (read whole), equal rows, empty tables (its result is empty) and
columns that have names of its own; those besides the columns of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import jaccard_join, mixing, packing, quality, secret_scan
from tidewater.llm.store import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged for itself; null and empty texts have too few words and go."""
    return quality.score(docs).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of least doc_id, and every text that is linked with none, whatever its doc_id; equal texts are linked, null is the least id."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS), percent=80, n=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars the new length; a null text stays null."""
    return secret_scan.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, at most twice; null is a source of its own, and texts without words weigh nothing."""
    return mixing.mix(docs.select(*COLUMNS), weights=(3, 1, 2), share=1.5, limit=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null or empty text is its closing id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, close=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Suffix arrays, tokens and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written and read back, so the next ones see one result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs

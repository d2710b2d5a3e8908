"""From raw documents to token ids: five stages, each by one operator of ``larder.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows of its input; all but the last
return the columns of documents. ``run`` writes each result as Parquet and reads it again for the next stage.

Defined results of every stage: an empty table gives an empty one; texts of any length are taken whole; doc_id may be null or
repeated; columns beyond doc_id and text are passed on whatever their names and values, but by the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import bpe, langid, minhash, mixing, secrets
from larder.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those in no learned language, go; repeated rows are judged alike, equally near languages by name."""
    return langid.spoken(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, stays of each group of near duplicates, and one row of those that repeat doc_id and text.

    Documents without words, null ones included, are near nothing and stay; so do rows without doc_id. Of rows that repeat both, the first by their other columns stays.
    """
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    left, place = docs.join(gone, "doc_id", "left_anti").select(*docs.columns), "_place"
    while place in docs.columns:
        place += "_"
    others = [c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]
    left = left.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*others)))
    return left.where((F.col(place) == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay, null texts as null, repeated rows each."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their rates say, to the nearest whole number; the targets keep what there is of each domain but toxic text.

    A document without words has the domains' frequencies as posteriors; rows of one doc_id take the highest of its rates; without labels all stay.
    """
    return mixing.mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")), dropped=("toxic",))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the bytes that they decode to, one row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; a null text has no token."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", encoding),
]

#: SQL can't express the fitted stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{number}")
    return docs

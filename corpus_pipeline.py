"""A corpus pipeline of five operators, each stage written as Parquet and read again.

Quality rules drop documents, line dedup cuts repeated lines (documents of which no line with a word is left go), the n-gram Jaccard
join keeps one row of the least doc_id of each group and all rows without doc_id, decontamination drops documents with benchmark passages, and what stays is
encoded. All stages but the last return the columns of `documents`. Line dedup expects unique
doc_ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm.bpe_codec import encode_decode
from prospecta.llm.common import numbered, read, release, written
from prospecta.llm.decontaminate import clean_documents
from prospecta.llm.jaccard import jaccard_components
from prospecta.llm.line_dedup import without_repeated_lines
from prospecta.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier line, and only those with a line left; n_chars follows the text."""
    cut = without_repeated_lines(docs, percent=80, k=1, drop_emptied=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of its least doc_id, by five-word shingles and a similarity of 0.8. Rows
    are numbered, so that rows of one doc_id are documents of their own; a row without doc_id is its own group."""
    rows, row = numbered(docs)
    known = rows.filter("doc_id is not null")
    groups = jaccard_components(known.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    least = known.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("least"))
    first = least.select(F.col(f"least.{row}").alias(row))
    return known.join(first, row, "left_semi").select(*docs.columns).unionAll(rows.filter("doc_id is null").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"), n=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and digests of the ids and of the text decoded from them."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]
#: The suffix array, components and BPE are beyond SQL; tests hold a brute-force version of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark)
    return docs

"""Queries of token counts, encoding and token files over `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prospecta.llm.bpe_codec import encode_decode
from prospecta.llm.common import read
from prospecta.llm.token_count import token_counts
from prospecta.llm.token_files import index_of, read_back, write_tokens


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json; tests hold the library's counts against it."""
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document by word_bpe_49k.json, as digests; tests hold the library against it."""
    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to token files in ascending doc_id order, and their index as read back."""
    files = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return index_of(read_back(files))


QUERIES = {"op3_token_counts": op3_token_counts, "op6_bpe_codec": op6_bpe_codec, "op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}

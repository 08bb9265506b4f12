"""Query of cross-tokenizer alignment over `documents`; tests hold a brute-force version against it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prospecta.llm.alignment import align
from prospecta.llm.common import read


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document by byte_bpe_50k.json and piece_bpe_32k.model."""
    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}

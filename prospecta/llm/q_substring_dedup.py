"""Query of suffix-array dedup over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospecta.llm.common import read
from prospecta.llm.substring_dedup import substring_dedup


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside 200-byte strings that start elsewhere too; tests hold a brute-force version."""
    return substring_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {}

"""Query of the quality rules over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospecta.llm.common import read
from prospecta.llm.quality import quality


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document; the suffix array is beyond SQL, so tests hold a brute-force version."""
    return quality(read(spark, sf_dir, "documents"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES: dict[str, str] = {}

"""Query of the n-gram Jaccard join over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospecta.llm.common import read
from prospecta.llm.jaccard import jaccard_components


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a similarity of 0.85; components are beyond plain SQL, so tests
    hold a brute-force version."""
    return jaccard_components(read(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {}

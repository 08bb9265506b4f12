"""Query of the secret scan over `documents`: an owner is a source, a repository a source and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import secrets
from prospecta.llm.common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and owner-specific spans of every document."""
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"), "n_specific", "n_copied", "most_repositories")


def _kind(order: int, pattern: str, test: str, flags: str = "") -> str:
    pattern = pattern.replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', 2)" if order == 0 else "m"
    return f"""SELECT doc_id, source, lang, {order} AS o, s, s + length(m) AS e, {value} AS v FROM (
      SELECT doc_id, source, lang, m, sum(length(p) + coalesce(length(lag_m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
        SELECT doc_id, source, lang, i, p, m, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS lag_m FROM (
          SELECT doc_id, source, lang, unnest(range(1, len(ms) + 1)) AS i, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m FROM (
            SELECT doc_id, source, lang, regexp_split_to_array(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM documents)))) WHERE {test}"""


LIVE = "regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]') AND len(list_distinct(regexp_extract_all({0}, '.'))) >= 8"
SQL = f"""
WITH c AS (
  {_kind(0, secrets.ASSIGN, "length(v) >= 6")} UNION ALL {_kind(1, secrets.ACCESS, "length(v) >= 20")}
  UNION ALL {_kind(2, secrets.HEX, "true")} UNION ALL {_kind(3, secrets.LONG, LIVE.format("v"))}
), f AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) <= 2 AS specific, count(DISTINCT coalesce(source, chr(0)) || chr(1) || concat_ws('/', source, lang)) AS repositories FROM c GROUP BY v),
j AS (SELECT c.*, specific, repositories FROM c JOIN f USING (v)),
r AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][o + 1] || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'owned'][o + 1] || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 3 OR specific) AS spans,
    count(DISTINCT v) FILTER (WHERE specific AND {LIVE.format("v")}) AS n_specific, count(DISTINCT v) FILTER (WHERE NOT specific) AS n_copied,
    max(repositories) FILTER (WHERE specific AND {LIVE.format("v")}) AS most_repositories
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_specific, 0) AS n_specific, coalesce(n_copied, 0) AS n_copied, coalesce(most_repositories, 0) AS most_repositories
FROM documents d LEFT JOIN r USING (doc_id)
"""
QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": SQL}

"""Query of personal data over `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import pii
from prospecta.llm.common import read


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, and the terms that disclose them, of every document."""
    found = pii.scan(read(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def _runs(pattern: str, name: str) -> str:
    """doc_id, s, e, m of all matches of a pattern."""
    return f"""{name} AS (
      SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, m FROM (
        SELECT doc_id, m, sum(length(p) + coalesce(length(lag_m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
          SELECT doc_id, i, p, m, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS lag_m FROM (
            SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m FROM (
              SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM documents)))))"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
SQL = rf"""
WITH {_runs(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "r0")}, {_runs(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "r1")},
{_runs(r"[0-9](?:[\x20-]?[0-9])+", "r2")}, {_runs(r"\+[0-9][\x20().0-9-]+[0-9]", "r3")}, {_runs(r"[\p{L}\p{N}_]{4,}", "r4")},
base AS (
  SELECT doc_id, 0 AS k, s, e, 'email:' || lower(m) AS v FROM r0
  UNION ALL SELECT doc_id, 1, s, e, 'ip:' || array_to_string(list_transform(string_split(m, '.'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END), '.') FROM r1
    WHERE len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(left('0' || ltrim(x, '0'), 4) AS INT) > 255)) = 0
  UNION ALL SELECT doc_id, 2, s, e, 'card:' || {DIGITS} FROM r2 WHERE length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(
    range(0, length({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({DIGITS}[length({DIGITS}) - i] AS INT) ELSE
      CAST({DIGITS}[length({DIGITS}) - i] AS INT) * 2 - CASE WHEN CAST({DIGITS}[length({DIGITS}) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  UNION ALL SELECT doc_id, 3, s, e, 'phone:' || {DIGITS} FROM r3 WHERE length({DIGITS}) BETWEEN 9 AND 15
), terms AS (
  SELECT doc_id, s, e, lower(m) AS t FROM r4 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r4.doc_id AND b.s < r4.e AND r4.s < b.e)
), near AS (
  SELECT doc_id, v, t, s, e FROM (
    SELECT b.doc_id, b.v, t.t, t.s, t.e, row_number() OVER (PARTITION BY b.doc_id, b.k, b.s, t.s < b.s ORDER BY abs(t.s - b.s)) AS n
    FROM base b JOIN terms t USING (doc_id)) WHERE n <= 25
), texts AS (SELECT doc_id, md5(text) AS h FROM documents),
ent AS (SELECT v, count(*) AS n_e FROM (SELECT DISTINCT doc_id, v FROM base) JOIN texts USING (doc_id) GROUP BY v HAVING count(DISTINCT h) >= 3),
pairs AS (SELECT v, t, count(*) AS n_et FROM (SELECT DISTINCT doc_id, v, t FROM near) JOIN texts USING (doc_id) GROUP BY v, t HAVING count(DISTINCT h) >= 3),
of_term AS (SELECT t, count(*) AS n_t FROM (SELECT DISTINCT doc_id, lower(m) AS t FROM r4) GROUP BY t),
told AS (
  SELECT v, t FROM pairs JOIN ent USING (v) JOIN of_term USING (t), (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
  WHERE n_e < n AND round(ln(n_et * n / (CAST(n_e AS DOUBLE) * n_t)) / ln(n / n_e), 9) >= 0.9
), added AS (SELECT DISTINCT doc_id, 4 AS k, s, e FROM near JOIN told USING (v, t)),
b AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 3) AS n3,
    string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM base GROUP BY doc_id
), a AS (
  SELECT doc_id, string_agg(['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM (SELECT doc_id, k, s, e FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
QUERIES = {"op12_pii": op12_pii}
ORACLES = {"op12_pii": SQL}

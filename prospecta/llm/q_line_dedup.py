"""Query of line dedup over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm.common import read
from prospecta.llm.line_dedup import dedup_report

PERCENT, SHINGLE = 80, 1


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that match an earlier line."""
    found = dedup_report(read(spark, sf_dir, "documents"), PERCENT, SHINGLE)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.array_join(F.transform("removed_lines", lambda i: i.cast("string")), ","), 256).alias("removed_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), s AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, len(w) AS n, w
  FROM (SELECT doc_id, line, list_distinct(list_transform(range(0, len(v) - {SHINGLE} + 1), lambda i: array_to_string(v[i + 1:i + {SHINGLE}], ' '))) AS w FROM l WHERE len(v) >= {SHINGLE})),
t AS (SELECT id, n, unnest(w) AS word FROM s),
f AS (SELECT word, count(*) AS c FROM t GROUP BY word),
r AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS pos FROM t JOIN f USING (word)),
p AS (SELECT * FROM r WHERE pos <= n - CAST(ceil(n * {PERCENT} / 100.0) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND b.id < a.id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
v AS (SELECT DISTINCT a FROM (SELECT c.a, len(list_intersect(x.w, y.w)) AS k, x.n + y.n AS nn FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b) WHERE 100 * k >= {PERCENT} * (nn - k)),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM s JOIN v ON s.id = v.a GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT n.doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(lines, '')) AS removed_sha256 FROM n LEFT JOIN g USING (doc_id)
"""
QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}

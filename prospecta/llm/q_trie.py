"""Query of the prefix trie over `conversations`, rebuilt so that they share openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospecta.llm import trie
from prospecta.llm.common import read, written


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations."""
    turns = written(trie.numbered_turns(read(spark, sf_dir, "conversations")), "positions")
    return trie.prefix_trie(*trie.shared_openings(turns))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT i AS byte, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM (SELECT unnest(range(0, 256)) AS i)
), own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (SELECT c, count(*) AS n FROM own GROUP BY c),
tab AS (SELECT list(v ORDER BY byte) AS t FROM crc),
dec AS (
  SELECT c, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 4 AS h
  FROM lengths, tab
), plan AS (
  SELECT d.c, d.h, d.c - d.c % 20 AS b, least(d.h, coalesce(l.n, 0)) AS taken FROM dec d LEFT JOIN lengths l ON l.c = d.c - d.c % 20
), turns AS (
  SELECT p.c, o.i, o.role, o.text FROM plan p JOIN own o ON o.c = p.b AND o.i < p.h
  UNION ALL SELECT p.c, o.i - p.h + p.taken, o.role, o.text FROM plan p JOIN own o ON o.c = p.c AND o.i >= p.h
), pre AS (
  SELECT c, 0 AS d, '' AS k, 0 AS words FROM plan
  UNION ALL SELECT c, i + 1, string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY i) OVER (PARTITION BY c ORDER BY i),
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) FROM turns
), nodes AS (SELECT d, k, min(c) AS node, count(*) AS n, max(words) AS words FROM pre GROUP BY d, k),
children AS (SELECT d - 1 AS d, left(k, 64 * (d - 1)) AS k, count(*) AS m FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT nodes.*, coalesce(m, 0) AS m FROM nodes LEFT JOIN children USING (d, k)),
sums AS (
  SELECT d, k, CAST(sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, CAST(sum((n - 1) * words) AS BIGINT) AS saved
  FROM (SELECT m, n, words, j AS d, left(k, 64 * j) AS k FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM full_)) GROUP BY d, k
), ends AS (
  SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM pre GROUP BY c) GROUP BY d, k
)
SELECT f.node AS conv_id, CAST(f.d AS BIGINT) AS depth, p.node AS parent_conv_id, f.n AS n_convs, f.m AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens,
  coalesce(e.sha, sha256('')) AS ends_sha256
FROM full_ f JOIN sums s USING (d, k) LEFT JOIN ends e USING (d, k) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = left(f.k, 64 * (f.d - 1))
"""
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": SQL}

"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from prospecta.llm import q_alignment, q_chat, q_decontaminate, q_jaccard, q_line_dedup, q_pii, q_quality, q_secrets, q_substring_dedup, q_tokens, q_trie

MODULES = (q_chat, q_quality, q_tokens, q_decontaminate, q_secrets, q_jaccard, q_line_dedup, q_substring_dedup, q_alignment, q_pii, q_trie)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from lexaudit.llm import queries_bpe, queries_chat, queries_collocations, queries_fim, queries_html, queries_media, queries_mixing, queries_near, queries_packing, queries_quality, queries_rules, queries_substrings, queries_warc

_MODULES = (queries_bpe, queries_chat, queries_collocations, queries_fim, queries_html, queries_media, queries_mixing, queries_near, queries_packing, queries_quality, queries_rules, queries_substrings, queries_warc)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

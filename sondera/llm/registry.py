"""The corpus queries: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from sondera.llm import edit_prints, exact_dedup, lexical, line_dedup, mixing, packing, quality, scoring, secrets, simhash, spelling, substring_dedup, tokens

_MODULES = (line_dedup, packing, tokens, quality, simhash, exact_dedup, mixing, scoring, substring_dedup, secrets, spelling, edit_prints, lexical)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLE_SQL = {m.NAME: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}

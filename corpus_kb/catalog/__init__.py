"""Registered queries and the DuckDB SQL each is checked against."""

from __future__ import annotations

from corpus_kb.catalog import code, conversation, delta, graph, quality, retrieval, runs, scan, segment, stream

_PARTS = (scan, code, segment, retrieval, graph, delta, quality, runs, conversation, stream)


def queries() -> dict:
    return {name: entry[0] for part in _PARTS for name, entry in part.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for part in _PARTS for name, entry in part.ENTRIES.items() if entry[1]}

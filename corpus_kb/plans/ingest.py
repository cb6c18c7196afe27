"""Pages to chunks to index to ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpus_kb.operators.search import search
from corpus_kb.operators.segment import chunk_pages


def search_documents(pages: DataFrame, queries: DataFrame, limit: int = 10, target_tokens: int = 512) -> DataFrame:
    """Chunk a page table and answer a table of questions over it."""
    chunks = chunk_pages(pages, target_tokens=target_tokens)
    hits = search(queries, chunks, limit=limit, max_terms=16, per_term=limit)
    return hits.select("query_id", "pos", "id", "page_path", "start_line", "end_line", "title", "score", "rank")

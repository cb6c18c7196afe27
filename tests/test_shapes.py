"""Table shapes on rows that larger inputs bring: shared addresses, chunks without grams."""

from corpus_kb import schemas
from corpus_kb.catalog import retrieval as queries
from corpus_kb.sources import tables as T
from corpus_kb.streaming import ingest


def test_links_of_pages_that_share_an_address(spark, tmp_path):
    rows = [(1, "u/a", '<a href="x">1</a><a href="x">2</a>'), (2, "u/a", '<a href="x">1</a><a href="y">2</a>'), (3, "u/b", '<a href="x">1</a>'), (4, "u/c", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, T.links(spark, str(tmp_path)).collect())) == [("u/a", "x"), ("u/a", "y"), ("u/b", "x")]


def documents(spark, tmp_path, rows):
    made = [(i, text, lang, f"src{i % 20}", len(text or "")) for i, (text, lang) in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_indexed_chunks_without_grams_are_not_missing(spark, tmp_path):
    """A chunk of an indexed language that is too short for a gram was indexed all the same; others are missing, short or not."""
    d = documents(spark, tmp_path, [("ab", "en"), ("whole words", "en"), ("ab", "fr"), ("whole words", "de"), ("\n\n\n", "en"), (None, "fr"), ("", "en")])
    want = {r.chunk_id for r in T.chunks(spark, d).collect() if r.page_path in ("d/src2/2.md", "d/src3/3.md")}
    got = [r.chunk_id for r in queries.index_gap(spark, d).collect()]
    assert sorted(got) == sorted(want) and len(got) == 2


def test_table_streams_read_folders_of_parts_and_single_files(spark, tmp_path):
    documents(spark, tmp_path, [("one", "en"), ("two", "fr"), ("three", "de")])
    parts = tmp_path / "documents.parquet"
    single = tmp_path / "single"
    single.mkdir()
    spark.read.parquet(str(parts)).coalesce(1).write.parquet(f"{tmp_path}/whole")
    next((tmp_path / "whole").glob("*.parquet")).rename(single / "documents.parquet")
    for k, folder in enumerate((tmp_path, single)):
        stream = ingest.table_stream(spark, str(folder), "documents", schemas.DOCUMENTS)
        ingest.run_to_end(stream, f"{tmp_path}/out{k}")
        assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out{k}/rows").collect()) == ["one", "three", "two"]

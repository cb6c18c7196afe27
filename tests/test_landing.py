"""Landing of pages with derived tables: against a batch rebuild, with replays, half-written batches and compaction."""

import pytest
from pyspark.sql import functions as F

from corpus_kb.operators import segment as C
from corpus_kb.operators import store as X
from corpus_kb.operators.graph import describes_relations
from corpus_kb.operators.index import gram_sets
from corpus_kb.session import shared_dir
from corpus_kb.streaming import landing as L

SCHEMA = "seq bigint, path string, repo string, module string, body string"


def page(path, n, claims=2, module="m"):
    body = f"# {path} v{n}\n" + f"word{n} " * 120 + "\n## Claims\n" + "".join(f"- statement number {i} of {n}\n" for i in range(claims))
    return n, path, "r", module, body


BATCHES = [
    [page("a.md", 1), page("b.md", 1), page("c.md", 1, module=None), (1, None, "r", "m", "# lost")],
    [page("a.md", 3, claims=1), page("a.md", 2), (4, "d.md", "r", "m", None)],
    [(5, "b.md", "r", None, "")],
    [page("e.md", 6), page("c.md", 6, claims=0)],
]


def newest(rows):
    out = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        out[r[1]] = r
    return list(out.values())


def held(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def same_as_rebuild(land, rows):
    pages = land.spark.createDataFrame(newest(rows), SCHEMA)
    chunks = C.chunk_pages(pages.select("path", "body"))
    for table, want, columns in (
        ("pages", pages, ["path", "repo", "module", "body"]), ("chunks", chunks, chunks.columns), ("claims", C.claims(pages), ["page_path", "ord", "statement", "evidence", "status"]),
        ("describes", describes_relations(pages, ("path",)), ["path", "src", "dst", "rel", "confidence"]),
    ):
        assert held(land.current(table), *columns) == held(want, *columns), table
    assert held(land.index().postings(), "gram", "chunk_id") == held(gram_sets(chunks, "chunk_id", list(L.INDEXED)), "gram", "chunk_id")


def test_batches_equal_a_rebuild(spark, monkeypatch):
    land, seen = L.Landing(spark, shared_dir(spark, "land"), buckets=4), []
    assert land.current("chunks").count() == 0 and not L.compact(land)
    for number, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, SCHEMA)
        if number == 1:  # the driver dies between the index and the commit
            with monkeypatch.context() as m:
                m.setattr(L.Landing, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    L.land_batch(land, batch, number)
            same_as_rebuild(land, seen)
        L.land_batch(land, batch, number)
        seen += rows
        if number in (1, 3):
            same_as_rebuild(land, seen)
            L.land_batch(land, spark.createDataFrame(BATCHES[0], SCHEMA), number)  # a replay of a committed number changes nothing
            assert L.compact(land) and len(land.commits()) == 1 and not L.compact(land)
            same_as_rebuild(land, seen)
    assert [(r.pages, r.describes) for r in land.commits()] == [(5, 4)]
    term = spark.createDataFrame([("word6",)], "term string")
    assert {r.chunk_id for r in X.candidates(land.index(), term).collect()} <= {r.chunk_id for r in land.current("chunks").collect()}


def test_stream_of_several_files(spark, tmp_path):
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    land = L.Landing(spark, str(tmp_path / "out"), buckets=4)
    L.land_stream(land, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    assert len(land.commits()) == 2
    same_as_rebuild(land, [r for rows in BATCHES for r in rows])
    assert land.current("pages").filter(F.col("body_hash").isNull()).count() == 1

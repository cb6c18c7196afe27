"""File readers and sinks on a temporary tree; streams against their batch twins over several files."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_kb import schemas
from corpus_kb.operators import conversation as V
from corpus_kb.operators import segment as C
from corpus_kb.sources import files as R
from corpus_kb.sources import sinks as K
from corpus_kb.streaming import ingest as S


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_listing_and_guards(spark, tmp_path):
    write(tmp_path, {"src/main.rs": "fn main() {}", "README.md": "hello", "target/x.rs": "x", "big.txt": "y" * 300, "nul.txt": b"a\x00b", "notes.md": "n"})
    listed = R.list_files(spark, str(tmp_path), "r")
    assert {(r["rel"], r["language"]) for r in R.keep_source_files(listed).collect()} == {("src/main.rs", "rust"), ("big.txt", None), ("nul.txt", None), ("notes.md", None)}
    assert {r["rel"] for r in R.keep_source_files(listed, own_files=["big.txt"], limit=2).collect()} == {"notes.md", "nul.txt"}
    assert {r["rel"] for r in R.read_texts(spark, str(tmp_path), max_bytes=200, glob="*.txt").collect()} == set()
    assert {r["rel"] for r in R.read_texts(spark, str(tmp_path), max_bytes=200).collect()} == {"src/main.rs", "README.md", "target/x.rs", "notes.md"}


def test_pages_and_point_reads(spark, tmp_path):
    write(tmp_path, {"a/b.md": "# B\n\nx", ".hidden.md": "h", "c.txt": "no"})
    pages = R.read_pages(spark, str(tmp_path))
    assert [tuple(r) for r in pages.collect()] == [("a/b.md", "# B\n\nx")]
    assert R.page_at(pages, "a/b.md").count() == 1 and R.page_at(pages, "../a/b.md").count() == 0


def test_ignore_per_repository(spark):
    files = spark.createDataFrame([("a", "x.log", None, 1), ("b", "x.log", None, 1)], schemas.FILES)
    from corpus_kb.functions.globs import ignore_rules

    rules = spark.createDataFrame([("a", "*.log\n")], "repo string, text string").select("repo", ignore_rules(F.col("text")).alias("rules"))
    assert [r["repo"] for r in R.keep_unignored(files, rules).collect()] == ["b"]


def test_claims_reader_is_tolerant(spark, tmp_path):
    write(tmp_path, {"a.json": '{"page":"p.md","claims":[{"statement":"s","evidence":["e"],"status":"active"}]}', "bad.json": "not json"})
    assert [(r["page_path"], r["statement"]) for r in R.read_claims(spark, str(tmp_path)).collect()] == [("p.md", "s")]


def test_page_sink_is_byte_stable(spark, tmp_path):
    page = spark.createDataFrame([("a.md", "T", "Module", "D", ["x", "y"], "\n\n# A\n\nbody  \n\n")], "path string, title string, page_type string, description string, tags array<string>, body string")
    first = K.page_texts(page).first()["content"]
    assert first == "---\ndescription: D\ntags: [x, y]\ntitle: T\ntype: Module\n---\n# A\n\nbody\n"
    K.write_pages(page, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["content"] == first
    K.write_index(page, str(tmp_path / "i"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "i")).collect()] == ["## .", "- [T](a.md) — D"]


def test_ingest_takes_the_newest_version(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "path string, body string"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    batches = [[("a.md", "# One\n" + "x" * 500), ("b.md", "# B\n" + "y" * 500)], [("a.md", "# Two\n" + "z" * 500 + "\n# Three\n" + "w" * 500)], [("b.md", "")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        S.ingest_pages(stream, out)
    got = sorted((r["page_path"], r["title"]) for r in S.current_chunks(spark, out).collect())
    assert got == [("a.md", "Three"), ("a.md", "Two")]


def test_rollback_equals_its_batch_twin_across_triggers(spark, tmp_path):
    kinds = ["delta", "delta", "reset", "delta", "mark", "delta", "reset", "mark", "delta", "delta", "mark", "delta"]
    rows = [(c, i, kinds[(i + c) % len(kinds)], f"t{i}") for i in range(60) for c in (1, 2, 3)]
    schema = "conv bigint, seq bigint, kind string, text string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in range(3):
        chunk = [r for r in rows if r[1] // 20 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(source))
    ordered = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    S.run_to_end(S.committed_deltas(ordered), out)
    twin = V.fold_deltas(spark.createDataFrame(rows, schema), committed_only=True)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect())) == sorted(map(tuple, twin.collect()))


def test_stream_chunks_equal_batch_chunks(spark, tmp_path):
    pages = spark.createDataFrame([(f"p{i}", "# T\n" + "word " * 200 * i) for i in range(6)], "path string, body string")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    S.ingest_pages(spark.readStream.schema("path string, body string").parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    got = sorted(map(tuple, S.current_chunks(spark, str(tmp_path / "out")).select("chunk_id", "ord").collect()))
    assert got == sorted(map(tuple, C.chunk_pages(pages).select("chunk_id", "ord").collect()))


@pytest.mark.parametrize("per_trigger", [1, 3])
def test_one_conversation_with_a_third_of_the_rows(spark, tmp_path, per_trigger):
    rng = random.Random(per_trigger)
    rows = [(7 if rng.random() < 0.34 else rng.randrange(100, 400), i, rng.choices(["delta", "mark", "reset"], [90, 4, 3])[0], None if i % 50 == 0 else f"t{i}") for i in range(6000)]
    schema = "conv bigint, seq bigint, kind string, text string"
    for part in range(6):
        spark.createDataFrame(rows[part * 1000 : part * 1000 + 1000], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
    S.run_to_end(S.committed_deltas(stream), str(tmp_path / "out"))
    twin = V.fold_deltas(spark.createDataFrame(rows, schema), committed_only=True)
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out/rows")).collect()))
    assert got == sorted(map(repr, twin.collect())) and len(got) > 1000


def test_status_and_progress_keep_no_state(spark, tmp_path):
    rows = [(run, seq, status, outcome) for run in range(50) for seq, status, outcome in ((1, "running", "a"), (2, "running", "b"), (3, "succeeded" if run % 2 else "failed", "a"))]
    random.Random(3).shuffle(rows)  # statuses arrive in any order over the triggers
    schema = "run_id bigint, seq bigint, status string, outcome string"
    for part in range(3):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, fold, total, columns in (("status", S.run_status, S.run_status, ["run_id", "status", "seq"]), ("progress", S.progress, S.total_progress, ["run_id", "outcome", "n"])):
        query = S.fold_parts(stream, str(tmp_path / name), fold)
        assert len(query.recentProgress) >= 3 and all(not p["stateOperators"] for p in query.recentProgress)
        landed = total(spark.read.parquet(str(tmp_path / name / "rows")))
        assert sorted(map(tuple, landed.select(columns).collect())) == sorted(map(tuple, fold(spark.createDataFrame(rows, schema)).select(columns).collect()))

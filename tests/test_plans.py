"""Physical plans: what must not shuffle does not, limits are cut before the shuffle, filters reach the scan."""

import pytest
from pyspark.sql import functions as F

from corpus_kb.operators import delta as D
from corpus_kb.operators import outline as O
from corpus_kb.operators import quality as Q
from corpus_kb.operators import scan as P
from corpus_kb.operators import search as S
from corpus_kb.operators import segment as C
from corpus_kb.operators import index as I
from corpus_kb.sources import files as R


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "pages")
    spark.range(200).select(
        F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("# T\nsome text here\n").alias("body"),
        F.lit("Module").alias("page_type"), F.lit("r").alias("repo"), F.col("id").alias("size"), F.lit("rust").alias("language"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_work_never_shuffles(pages):
    texts = pages.select("repo", F.col("path").alias("rel"), "language", "size", F.col("body").alias("text"))
    for df in (
        C.chunk_pages(pages), C.sections(pages), C.fence_state(pages), C.fold_runs(pages), C.compaction(pages), C.claims(pages), C.first_headings(pages),
        Q.quality_report(pages), O.outline(texts), O.grep(texts, "text"), I.gram_postings(C.chunk_pages(pages), "chunk_id", ["body"]),
    ):
        assert "Exchange" not in plan(df)


def test_scan_matching_only_broadcasts_the_dictionary(spark, pages):
    terms = spark.createDataFrame([("text",), ("so",)], "term string")
    text = plan(S.match_terms(terms, C.chunk_pages(pages), "chunk_id", ["title", "summary"], ["body"]))
    streamed = text.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in streamed


def test_top_k_is_cut_before_the_shuffle(pages):
    pairs = pages.select("repo", "path")
    assert "WindowGroupLimit" in plan(P.capped_lists(pairs, "repo", "path", 5))
    texts = pages.select("repo", F.col("path").alias("rel"), "language", "size", F.col("body").alias("text"))
    assert "WindowGroupLimit" in plan(O.outline_summary(texts, 14, 4200))


def test_filters_and_columns_reach_the_scan(pages):
    point = plan(R.page_at(pages, "d/7.md").select("body"))
    assert "EqualTo(path,d/7.md)" in point and "page_type" not in point.split("ReadSchema")[1]
    scoped = plan(P.in_scope(pages.select(F.col("path").alias("rel"), "language"), "src/a"))
    assert "StringStartsWith(path,src/a/)" in scoped and "body" not in scoped.split("ReadSchema")[1]


def test_upserts_shuffle_keys_of_the_old_rows_once(pages):
    new = pages.withColumn("seq", F.lit(1)).limit(3)
    text = plan(D.upsert(pages, new, ["path"], "seq"))
    assert "LeftAnti" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_query_forms_a_product(spark):
    import __spark_entry__ as entry

    skipped = ("T1_", "T2_stream", "T3_stream", "T4_", "T5_", "T7_", "T8_", "U11_", "S8_", "K7_chunk", "R1_R5", "R5_R6", "R7_", "R8_", "R9_", "K6_", "op", "pipeline")
    for name, fn in entry.queries().items():
        if not name.startswith(skipped):
            text = plan(fn(spark, "/root/testdata/sf0.001"))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_replacing_pages_sorts_no_postings(spark):
    chunks = spark.createDataFrame([("c1", "p1", "aa"), ("c2", "p2", "bb")], "chunk_id string, page_path string, body string")
    rows = lambda c: c.select("chunk_id", F.lit("g").alias("gram"))
    pages = spark.createDataFrame([("p1",)], "page_path string")
    c, p, m = D.replace_pages(chunks, rows(chunks), rows(chunks), chunks.limit(0), pages, rows, rows)
    assert [r.chunk_id for r in p.collect()] == ["c2"] == [r.chunk_id for r in m.collect()]
    for df in (c, p, m):
        # held by hash from the start, before any run-time statistics
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("most", [None, 0])
def test_details_of_hits_shuffle_no_chunk_and_no_entity_within_the_bound(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(S, "MAX_BROADCAST_HITS", most)
    chunks = spark.range(300).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("p").alias("page_path"),
                                     F.lit("body").alias("body"), F.col("id").alias("start_line"), F.col("id").alias("end_line"))
    entities = spark.range(300).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"), F.lit("k").alias("canonical_key"))
    top = spark.createDataFrame([(1, 1, "chunk", "c7", 1.0, 1.0), (1, 2, "nation", "e9", 1.0, 1.0), (2, 1, "chunk", "c7", 1.0, 1.0)], "query_id long, pos long, kind string, id string, score double, rank double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S._with_details(top, chunks, entities)
        assert sorted((r.query_id, r.pos, r.id, r.title, r.body) for r in df.collect()) == [(1, 1, "c7", "t", "body"), (1, 2, "e9", "n", None), (2, 1, "c7", "t", "body")]
        text = plan(S._with_details(top, chunks, None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in text) == (most == 0) and ("hashpartitioning" in text) == (most == 0)

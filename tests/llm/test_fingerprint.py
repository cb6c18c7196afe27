import hashlib

from pyspark.sql import functions as F

from corpus_kb.llm import fingerprint
from corpus_kb.llm.common import table

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_query_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 100:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert len(errors) > 500 and abs(sum(errors) / len(errors)) < 0.01 and sum(e * e for e in errors) / len(errors) < 0.06**2


def test_walk_in_small_buckets_equals_the_global_order(spark):
    docs = spark.createDataFrame([(i * 37 % 1009 - 300, f"t{i}") for i in range(200)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {(r.doc_id, r.text): r.next.text for r in fingerprint.with_next(docs, ["text"], bucket_rows=7).collect()}
    assert got == {rows[k]: rows[(k + 1) % 200][1] for k in range(200)}


def test_edges(edge_docs, edge_rows, no_docs):
    rows = sorted(((i is not None, i or 0), t or "") for i, t in edge_rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_chars, r.edited_sha256) for r in fingerprint.compare(edge_docs).collect())
    want = []
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)
    assert fingerprint.compare(no_docs).count() == 0


def test_equal_texts_have_equal_fingerprints_and_likeness_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "tiny"), (4, "tiny"), (5, ""), (6, None), (7, "other")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint != "" and got[3].fingerprint == got[4].fingerprint and got[5].fingerprint == ""
    assert [got[i].near_next for i in (1, 3, 5)] == [1.0, 1.0, 1.0] and got[6].near_next == 0.0


def test_merge_and_containment(spark):
    first, second = (" ".join(f"w{i}" for i in span) for span in (range(4000), range(3500, 4500)))
    df = spark.createDataFrame([(first, second)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    row = df.select(fingerprint.containment(F.col("b"), F.col("a")).alias("c"), F.size(fingerprint.merge(F.col("a"), F.col("b"))).alias("n"), F.size("a").alias("na")).first()
    assert abs(row.c - 0.5) < 0.12 and row.n > row.na
    assert abs(row.na * fingerprint.SCALE / 3996 - 1) < 0.15

import zlib
from collections import Counter

import numpy as np

from corpus_kb.llm import sharding


def test_matrix_rows_have_the_sums_of_the_matrix():
    rows, columns = np.array([7, 0, 12, 5, 9]), np.array([10, 3, 20])
    matrix = np.array([sharding.matrix_row(p, rows, columns, 1) for p in range(5)])
    assert (matrix.sum(1) == rows).all() and (matrix.sum(0) == columns).all()


def test_matrix_has_the_moments_of_a_uniform_permutation():
    rows, columns = np.array([6, 4, 2]), np.array([5, 7])
    draws = np.array([[sharding.matrix_row(p, rows, columns, seed)[0] for p in range(3)] for seed in range(3000)])
    assert np.allclose(draws.mean(0), rows * 5 / 12, atol=0.08)
    variance = rows * (5 / 12) * (7 / 12) * (12 - rows) / 11
    assert np.allclose(draws.var(0), variance, atol=0.08)


def test_large_populations_draw_like_small_ones(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 1)
    for good, bad, n in ((300, 500, 200), (500, 300, 600), (40, 9000, 4500)):
        draws = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        mean, total = n * good / (good + bad), good + bad
        assert abs(draws.mean() - mean) < 0.05 * mean + 0.5
        assert abs(draws.var() / (mean * bad / total * (total - n) / (total - 1)) - 1) < 0.15
        assert draws.min() >= max(0, n - bad) and draws.max() <= min(good, n)


def test_shards(edge_docs, edge_rows):
    for bucket_rows in (100_000, 2):
        got = sharding.shard(edge_docs, shards=3, bucket_rows=bucket_rows).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 3
        for s, n in sizes.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_more_shards_than_rows_and_no_rows(edge_docs, no_docs):
    got = sharding.shard(edge_docs, shards=40).collect()
    assert len({r.shard for r in got}) == len(got) == 16 and {r.slot for r in got} == {0}
    assert sharding.shard(no_docs).count() == 0


def test_order_is_shuffled_and_repeatable(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(4, "doc_id")
    one, two = ([(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs).orderBy("doc_id").collect()] for _ in range(2))
    assert one == two
    at = np.array([250 * s + k for _, s, k in one])
    assert abs(np.corrcoef(np.arange(4000), at)[0, 1]) < 0.06

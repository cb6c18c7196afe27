"""Grams of texts against a plain count."""

from collections import Counter

import pytest

from corpus_kb.operators import index as I


@pytest.mark.parametrize("slice_rows", [500, 2])
def test_postings_and_sets_against_a_plain_count(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(I, "SLICE_ROWS", slice_rows)
    rows = [("a", "Alpha", "banana\nanana"), ("b", None, ""), ("c", "ab", "😀灯塔😀灯塔"), ("d", "", None), ("e", "aaaa", "AAA\r\n\tİz"), ("f", "x", "y" * 3000)]
    df = spark.createDataFrame(rows, "chunk_id string, title string, body string")
    count, sets = Counter(), set()
    low = {r[0]: r[1:] for r in df.selectExpr("chunk_id", "lower(title)", "lower(body)").collect()}
    for cid, texts in low.items():
        for t in (t or "" for t in texts):
            count.update((t[k:k + 3], cid) for k in range(len(t) - 2))
            sets |= {((t + I.PAD)[k:k + 3], cid) for k in range(len(t))}
    assert sorted(map(tuple, I.gram_postings(df, "chunk_id", ["title", "body"]).collect())) == sorted((g, c, n) for (g, c), n in count.items())
    assert sorted(map(tuple, I.gram_sets(df, "chunk_id", ["title", "body"]).collect())) == sorted(sets)

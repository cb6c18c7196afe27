import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_kb.llm import jaccard
from corpus_kb.llm.common import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    """(doc_id, size, component) of rows (doc_id, text) with different ids, by comparing all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())


def variants(seed, n, common=()):
    """Texts in families: edits of a few words, chains of edits, texts around one shared passage."""
    rng, rows = random.Random(seed), []
    while len(rows) < n:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 9, 14, 30, 60, 150]))] + list(common)
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = f"w{rng.randrange(5000)}"
    return rows[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = variants(seed, 250)
    assert run(spark, rows) == brute(rows)


def test_shared_passage_and_dear_entries(spark, monkeypatch):
    monkeypatch.setattr(jaccard.dear_entries, "__defaults__", (jaccard.SAMPLE_DOCS, 3))
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "COMBINE", 7)
    rows = variants(5, 200, common=[f"passage{i}" for i in range(40)])
    assert run(spark, rows) == brute(rows)


def test_whole_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(6, 120), st.floats(0, 1), st.integers(0, 2))
def test_similar_sets_share_an_entry(seed, size, dear_share, mode):
    """The guarantee itself, for any list of dear subsets, at the least similarity allowed."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 3 * size, dtype=np.int64).view(np.uint64)
    a = np.unique(pool[:size])
    b = a
    # walk away from a until one more step would end the similarity
    for k in range(size):
        step = np.unique(np.concatenate([b[1:], pool[size + k : size + k + 1]])) if mode == 0 else b[1:] if mode == 1 else np.unique(np.append(b, pool[size + k]))
        if not jaccard.similar(a, step):
            break
        b = step
    none = np.zeros(0, np.uint64)
    bands = [jaccard.band_of(len(x)) for x in (a, b)]
    every = np.unique(np.concatenate([jaccard.entries(x, band + d, none)[0] for x, band in zip((a, b), bands, strict=True) for d in (0, 1)]))
    dear = np.sort(rng.choice(every, int(dear_share * len(every)), replace=False)) if len(every) else none
    mine, other = (np.concatenate([jaccard.entries(x, band + d, dear)[0] for d in (0, 1)]) for x, band in zip((a, b), bands, strict=True))
    assert np.array_equal(a, b) or len(np.intersect1d(mine, other))


def test_bit_maps_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 40) :], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
        apart = int(np.bitwise_count(jaccard.bitmap(a).view(np.uint64) ^ jaccard.bitmap(b).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_exact_threshold(spark):
    # 17 common shingles of 20 in all are linked, 16 of 19 are not
    words = [f"w{i}" for i in range(23)]
    linked = [(1, " ".join(words[:20])), (2, " ".join(words[:20] + ["x1", "x2", "x3"]))]
    assert [len(plain_set(t)) for _, t in linked] == [17, 20]
    apart = [(11, " ".join(words[:19]).replace("w", "v")), (12, " ".join(words[:19] + ["y1", "y2", "y3"]).replace("w", "v"))]
    assert run(spark, linked + apart) == brute(linked + apart) == [(1, 17, 1), (2, 20, 1), (11, 16, 11), (12, 19, 12)]


def test_long_chain(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 100])) for k in range(60)]
    assert run(spark, rows) == brute(rows)


def test_edges(edge_docs, no_docs):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in jaccard.join(edge_docs).collect())
    sizes = {i: n for i, n, _ in got}
    assert len(got) == 16 and [sizes[i] for i in (1, 2, 3, 4, 5, 6, 13, 12)] == [0, 0, 0, 1, 1, 1, 1, 1]
    component = {i: c for i, _, c in got}
    assert component[-1] is None and component[5] == 4 and component[8] == 7 and component[13] == 6 and component[10] == 9 and component[2] == 2
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 9, 11, 12]
    assert kept.where("doc_id IS NULL").count() == 2
    assert jaccard.join(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("key_bytes, pack", [(1, 3), (6, 50_000)])
def test_entries_that_share_their_bits_lose_no_link(spark, monkeypatch, key_bytes, pack):
    """With one byte of hash nearly all documents fall into common groups; packs of members are cut."""
    monkeypatch.setattr(jaccard, "KEY_BYTES", key_bytes)
    monkeypatch.setattr(jaccard, "PACK", pack)
    monkeypatch.setattr(jaccard, "LEAST_BUCKET", 100)
    rows = [(-i if i % 3 else 2**40 + i, t) for i, t in variants(8, 120)]
    assert run(spark, rows) == brute(rows)


def test_entries_are_exchanged_in_packs(spark):
    """A row for each batch and bucket instead of one for each entry: shuffled before were some 300 rows of 21 bytes a document."""
    docs = spark.createDataFrame([(i, t) for i, t in variants(3, 300)], "doc_id long, text string").coalesce(2)
    found = jaccard.groups(docs, docs.select(jaccard.F.col("doc_id").alias("id")), np.zeros(0, np.uint64), buckets=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "pack" in plan and "Window" not in plan


def test_kept_rows_are_not_shuffled(spark):
    """Texts of rows that stay are not exchanged; beyond the bound the same rows come by a join."""
    rows = variants(4, 200)
    docs = spark.createDataFrame([*rows, *rows[:2], (None, "no id")], "doc_id long, text string").repartition(3).localCheckpoint()
    kept = jaccard.keep_one(docs)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    want = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert want == sorted([("None", "no id"), *((str(i), dict(rows)[i]) for i, _, c in brute(rows) if i == c)])
    assert want == sorted((str(r.doc_id), r.text) for r in jaccard.keep_one(docs, most=0).collect())

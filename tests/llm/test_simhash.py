import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_kb.llm import simhash
from corpus_kb.llm.common import table
from tests.llm.test_jaccard import WORD

WORDS64 = st.integers(0, 2**64 - 1)


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{id: smallest id reachable} by comparing all pairs."""
    top = {i: i for i in fps}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: root(i) for i in fps}


def run(docs):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.join(docs).collect())


def brute(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    found = plain_components(fps)
    return sorted((i, f"{fps[i]:016x}", found[i]) for i in fps)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_query(spark, folder):
    docs = table(spark, f"/root/testdata/{folder}", "documents")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_short_texts_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.choice([1, 2, 3, 4, 300])))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs) == brute(rows)


def test_every_word_is_within_three_bits_of_one_codeword():
    of_byte, errors, n = simhash._code()
    assert sorted(set(n.tolist())) == [1, 6] and int((n == 6).sum()) == 1771
    x = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    keys, count = simhash.codeword_keys(x)
    nearest = x ^ errors[of_byte[0, x & 255] ^ of_byte[1, x >> 8 & 255] ^ of_byte[2, x >> 16 & 255], 0]
    assert (np.bitwise_count(x ^ nearest) <= 3).all() and (keys[:, 0] == nearest >> 11).all() and set(count.tolist()) == {1, 6}
    # the keys are what the word and its neighbours decode to
    for word, k, c in zip(x[:200].tolist(), keys, count, strict=False):
        around = simhash.codeword_keys(np.array([word, *(word ^ 1 << b for b in range(23))]))[0][:, 0]
        assert set(around.tolist()) == set(k[:c].tolist())


@settings(max_examples=500, deadline=None)
@given(WORDS64, st.lists(st.integers(0, 63), max_size=2))
def test_words_within_two_bits_share_an_entry(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    one, two = (set(simhash.entries(np.array([v], np.uint64).view(np.int64))[0].tolist()) for v in (x, y))
    assert one & two and max(len(one), len(two)) <= 48


@pytest.mark.parametrize("bucket", [2, 5, 256])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    """Dense families around a few centres: buckets beyond the bound meet by midpoints."""
    rng = random.Random(bucket)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fps.add(x)
            for _ in range(rng.choice([1, 1, 2, 3, 4])):
                x ^= 1 << rng.randrange(64)
    top = {v - (1 << 64) if v >> 63 else v: v for v in fps}
    df = spark.createDataFrame([(v,) for v in top], "fp long").repartition(3)
    groups = {v: {v} for v in top}
    for r in simhash.links(df, bucket).collect():
        merged = groups[r.a] | groups[r.b]
        for m in merged:
            groups[m] = merged
    assert {top[v]: min(top[m] for m in g) for v, g in groups.items()} == plain_components({v: v for v in fps})


def test_large_bucket_is_not_expanded(spark):
    """All 4,096 words over twelve bits: one component through midpoints, with edges in proportion to the words."""
    df = spark.range(4096).select((F.col("id") * 16).alias("fp"))
    edges = simhash.links(df, 64).collect()
    assert len(edges) < 4096 * 65
    seen, left = {0}, {(r.a, r.b) for r in edges}
    while new := {x for e in left if seen & set(e) for x in e} - seen:
        seen |= new
    assert len(seen) == 4096


def test_edges(edge_docs, no_docs):
    got = simhash.join(edge_docs).collect()
    assert len(got) == 16
    component = {r.doc_id: r.component_id for r in got}
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1, 2, 3, None} and {component[i] for i in (1, 2, 3)} == {1} and component[None] is None
    assert component[5] == 4 and component[8] == 7 and component[13] == 6 and component[10] == 9
    assert simhash.join(no_docs).count() == 0

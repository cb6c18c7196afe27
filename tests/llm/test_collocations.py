import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_kb.llm import collocations
from corpus_kb.llm.common import table

PIECE, WORD = re.compile(rb"[.,;:!?\x0A-\x0D]"), re.compile(rb"[^\x20\x09]+")


def brute(rows, least=100, top=2000):
    """Result rows from (lang, text) by plain counting."""
    f: dict = {}
    for lang, text in rows:
        for piece in PIECE.split((text or "").encode().lower()):
            words = WORD.findall(piece)
            mine = f.setdefault(lang or ("und" if lang is None else lang), Counter())
            for k in range(1, 6):
                mine.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        candidates = {p: v for p, v in counts.items() if len(p) > 1 and v >= least}
        covered = set()
        for p, v in candidates.items():
            for k in range(2, len(p)):
                covered |= {q for i in range(len(p) - k + 1) for q in [p[i : i + k]] if v >= counts[q]}
        ranked = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, b" ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, lo, hi, n, -s) for i, (s, a, p, lo, hi) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def run(docs, **kwargs):
    return sorted(tuple(r) for r in collocations.mine(docs, **kwargs).collect())


@pytest.mark.parametrize("folder,least", [("sf0.001", 5), ("sf0.01", 100), ("sf0.01", 12)])
def test_whole_query(spark, folder, least):
    docs = table(spark, f"/root/testdata/{folder}", "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert run(docs, least=least) == brute(rows, least)


def texts(seed, n):
    rng, words = random.Random(seed), ["a", "b", "the", "é", "\x01x", "x\x00", "日本", "zz", "-", "a-b"]
    return [(rng.choice(["en", "en", "en", "und", None, "a b"]), "".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choice([" "] * 9 + ["\t ", ". ", "!", "\n", "  "]) for _ in range(rng.choice([0, 1, 5, 300])))) for _ in range(n)]


@pytest.mark.parametrize("ranges,bits,split", [(1, 24, 500_000), (7, 16, 3), (40, 24, 50)])
def test_ranges_filters_and_splits_change_nothing(spark, ranges, bits, split):
    rows = [*texts(3, 150), (None, None), ("en", "THE B. The b! the B\x0cthe b")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert run(docs, least=6, top=50, ranges=ranges, word_bits=bits, pair_bits=bits, bucket_phrases=11, split_requests=split) == brute(rows, 6, 50)


@pytest.mark.parametrize("longest,pairs", [(5, False), (2, False), (5, True)])
def test_shards_in_parts(longest, pairs):
    every = np.full(1 << 13, 255, np.uint8)
    some = np.random.default_rng(1).integers(0, 256, 1 << 13).astype(np.uint8) if pairs else None
    shard, want = collocations.Shard(every, some, longest), Counter()
    for _, text in texts(5, 30):
        shard.add("en", (text or "").encode())
        for piece in PIECE.split((text or "").encode().lower()):
            words = WORD.findall(piece)
            go = [not pairs or bool(collocations.holds(some, collocations.phrase_hashes([b" ".join(p)]))[0]) for p in zip(words, words[1:], strict=False)] + [False]
            for i in range(len(words)):
                k = 1
                while k < longest and go[i + k - 1]:
                    k += 1
                if k > 1 or not pairs:
                    want[tuple(words[i : i + k])] += 1
    got: Counter = Counter()
    for _, words, paths, counts in shard.sorted_paths(7):
        for row, c in zip(paths.tolist(), counts.tolist(), strict=True):
            got[tuple(words[i - 1] for i in row if i)] += c
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), min_size=1, max_size=5), st.integers(1, 4)), min_size=1, max_size=40), st.integers(1, 4))
def test_transducers_unite_and_round_trip(items, parts):
    words = [b"a", b"b", b"c", b"dd"]
    want: Counter = Counter()
    built = []
    for i in range(parts):
        mine = items[i::parts]
        if mine:
            for p, w in mine:
                want[tuple(p)] += w
            built.append(collocations.build(words, *collocations.summed(collocations._numbered(words, [b" ".join(p) for p, _ in mine]), np.array([w for _, w in mine]))))
    t = collocations.Transducer.unpack(collocations.union(built).pack())
    paths, weight = t.paths()
    assert {tuple(t.words[i - 1] for i in row if i): w for row, w in zip(paths.tolist(), weight.tolist(), strict=True)} == dict(want)
    asked = [*want, (b"a", b"nowhere"), (b"dd",) * 5]
    assert t.weights_of(collocations._numbered(t.words, [b" ".join(p) for p in asked])).tolist() == [want.get(p, 0) for p in asked]
    # minimal: no two states of a level have the same arcs
    for d, (first, label, target) in enumerate(zip(t.first, t.label, t.target, strict=True)):
        arcs = [tuple(zip(label[s:e].tolist(), target[s:e].tolist(), t.weight[s:e].tolist() if d == 4 else [0] * (e - s), strict=True)) for s, e in zip(first[:-1], first[1:], strict=True)]
        assert len(set(arcs)) == len(arcs)


def test_large_products_are_exact(spark):
    """Whole numbers beyond 64 bits, by way of the final expression."""
    row = spark.sql("SELECT cast(cast(7000000000000 as decimal(38,0)) * 1000 * cast(9000000000001 as decimal(38,0)) as decimal(38,0)) div cast(cast(7000000000001 as decimal(38,0)) * cast(7000000000000 as decimal(38,0)) as decimal(38,0)) AS s").first()
    assert row.s == 7000000000000 * 1000 * 9000000000001 // (7000000000001 * 7000000000000)


def test_edges(edge_docs, no_docs, edge_rows):
    assert collocations.mine(no_docs).count() == 0
    assert run(edge_docs, least=2) == brute([("en", t) for _, t in edge_rows], 2)
    assert run(edge_docs) == brute([("en", t) for _, t in edge_rows])

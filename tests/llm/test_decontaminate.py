import itertools
import random
import re

import numpy as np
import pytest

from corpus_kb.llm import decontaminate as D
from corpus_kb.llm.common import table

SF = "/root/testdata/sf0.1"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_query_against_exact_passages(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    grams: dict = {}
    for r in items.collect():
        w = words(r.text)
        for j in range(len(w) - 12):
            grams.setdefault(tuple(w[j : j + 13]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = words(r.text)
        for j in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in grams.get(tuple(w[j : j + 13]), ())}
    got = D.contaminated(docs, items).collect()
    assert len(want) > 200 and want <= {(r.doc_id, r.item_id) for r in got}
    # whatever else is found agrees in four words of five
    assert all(r.matched >= D.EQUAL * min(D.OVERLAP, r.item_words) for r in got) and len(got) <= 1.02 * len(want)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items, block_words=1500).collect()} == {(r.doc_id, r.item_id) for r in got}


def test_substitutions_are_tolerated():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]) for k in range(60)]
    index = D.Index([(k, " ".join(w).encode()) for k, w in items])
    bits, reader, found = np.unpackbits(index.bits).astype(bool), D.Words(), 0
    for k, w in items:
        changed = [rng.choice(vocabulary) if i % 8 == 5 else x for i, x in enumerate(w)]
        text = " ".join([rng.choice(vocabulary) for _ in range(30)] + changed + [rng.choice(vocabulary) for _ in range(30)])
        rows = list(index.rows([text.encode()], reader, bits))
        found += any(r[1] == k and r[4] <= 33 and r[5] >= 27 + len(w) for r in rows)
    assert found >= 58
    clean = [" ".join(rng.choice(vocabulary) for _ in range(300)).encode() for _ in range(200)]
    assert not list(index.rows(clean, reader, bits))


@pytest.mark.parametrize("window", range(1, 14))
def test_every_set_of_changed_words_leaves_a_seed(window):
    may_differ = window - D.needed(window)
    for changed in itertools.combinations(range(window), may_differ):
        assert any(all(m == "0" or k + i not in changed for i, m in enumerate(mask))
                   for mask in D.masks(window) for k in range(window - len(mask) + 1))


def by_brute_force(item, text):
    """(equal words, first, last + 1) of the best diagonal whose windows agree enough."""
    w, best = min(D.OVERLAP, len(item)), None
    for diagonal in range(-len(item), len(text)):
        good = [k for k in range(len(item) - w + 1) if 0 <= diagonal + k and diagonal + k + w <= len(text)
                and sum(item[k + i] == text[diagonal + k + i] for i in range(w)) >= D.needed(w)]
        if good:
            a, b = good[0], good[-1] + w
            best = max(best or (0, 0, 0), (sum(item[k] == text[diagonal + k] for k in range(a, b)), diagonal + a, diagonal + b))
    return best


def test_short_items_and_isolated_windows_against_brute_force():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(900)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, draw(5 + k % 16)) for k in range(160)]
    index = D.Index([(k, " ".join(w).encode()) for k, w in items])
    bits, reader, texts, planted = np.unpackbits(index.bits).astype(bool), D.Words(), [], []
    for k, w in items:
        n = min(D.OVERLAP, len(w))
        start = rng.randrange(len(w) - n + 1)
        part = w[start : start + n]
        for i in rng.sample(range(n), n - D.needed(n)):
            part[i] = "changed"
        texts.append(draw(rng.randrange(9)) + part + draw(rng.randrange(9)))
        planted.append(k)
    got = {(r[0], r[1]): (r[2], r[4], r[5]) for r in index.rows([" ".join(x).encode() for x in texts], reader, bits)}
    assert all((n, k) in got for n, k in enumerate(planted))
    want = {(n, k): b for n, x in enumerate(texts) for k, w in items if (b := by_brute_force(w, x))}
    assert got == want


def test_unspaced_scripts_and_equal_items(spark):
    item = "港口的灯塔在夜里为船只指路直到天亮"
    items = spark.createDataFrame([(1, item), (2, item), (3, "ab 港口 x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "前言。" + item.replace("夜", "晚") + "。后记"), (2, "别的文字没有关系"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(1, 1), (1, 2)}
    assert {r.doc_id for r in D.clean(docs, items).collect()} == {2, 3} == {r.doc_id for r in D.clean(docs, items, block_words=4).collect()}


def test_least_is_off_unless_given(spark):
    items = spark.createDataFrame([(1, "amber lantern quay")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "The amber lantern, quay side"), (2, "amber quay lantern")], "doc_id long, text string")
    assert [r.doc_id for r in D.contaminated(docs, items).collect()] == [1] and D.contaminated(docs, items, least=D.LEAST).count() == 0


def test_a_passage_that_many_items_share():
    """No item is lost; windows at the ends of the passage reach one changed word further."""
    shared = [f"s{k}" for k in range(40)]
    items = [(k, " ".join([f"a{k}", *shared, f"b{k}"]).encode()) for k in range(3000)]
    index = D.Index(items)
    text = " ".join(["x", *shared, "y"]).encode()
    rows = list(index.rows([text] * 3, D.Words(), np.unpackbits(index.bits).astype(bool)))
    assert [(r[0], r[1]) for r in rows] == [(d, k) for d in range(3) for k in range(3000)] and {r[2:] for r in rows} == {(40, 42, 0, 42)}


def test_overlap_at_the_ends_and_across_chunks(monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WORDS", 10)
    item = " ".join(f"i{k}" for k in range(30))
    index = D.Index([(7, item.encode()), (8, b"five words are an item"), (9, b"too few"), (10, b"")])
    bits = np.unpackbits(index.bits).astype(bool)
    tail, head = " ".join(f"i{k}" for k in range(15, 30)), " ".join(f"i{k}" for k in range(14))
    texts = [b"", f"{tail} and more".encode(), f"before {head}".encode(), b"nothing", b"Five words, are AN item!", b"too few", item.encode()]
    rows = list(index.rows(texts, D.Words(), bits))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows] == [(1, 7, 15, 0, 15), (2, 7, 14, 1, 15), (4, 8, 5, 0, 5), (6, 7, 30, 0, 30)]


@pytest.mark.parametrize("block_words", [500_000, 8])
def test_edges(spark, edge_docs, no_docs, block_words):
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "once again the same words in the same order", 1), (3, "the same words in the same order once again", 1), (None, "a text without an id that is long", 1)], "item_id long, text string, doc_id int")
    got = D.contaminated(edge_docs, items, block_words).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(7, 3), (8, 3), (None, None)} and sum(r.doc_id == 8 for r in got) >= 2
    kept = D.clean(edge_docs, items, block_words)
    assert kept.columns == edge_docs.columns and kept.count() == 12 and {r.doc_id for r in kept.collect()}.isdisjoint({7, 8})
    assert D.contaminated(no_docs, items).count() == 0 and D.clean(no_docs, items).count() == 0
    assert D.contaminated(edge_docs, items.limit(0)).count() == 0 and D.clean(edge_docs, items.limit(0)).count() == 16

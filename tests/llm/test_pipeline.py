import zlib
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_kb.llm import decontaminate, quality, toxicity
from corpus_kb.llm.common import table, tokenizer_path
from tests.llm.test_decontaminate import words
from tests.llm.test_jaccard import WORD, brute, variants

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents").withColumn("extra", F.lit("e")).cache()
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    labels = table(spark, SF, "labels")
    for name, module, column, good in (("quality classifier", quality, "quality", 1), ("toxicity", toxicity, "toxic", 0)):
        scored = module.score(docs, module.train(docs, labels, column)).where(F.col("predicted") == good)
        out = steps[name](spark, docs, SF).cache()
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in scored.collect()}
        truth = {r.doc_id: r[column] for r in labels.collect()}
        wrong = [truth[i] for i in {r.doc_id for r in docs.collect()} & set(truth) if (i in {r.doc_id for r in out.collect()}) != (truth[i] == good)]
        assert len(wrong) <= 0.05 * len(truth)
        docs = out
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = steps["n-gram Jaccard join"](spark, docs, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == five_word_kept(rows) and one.columns == docs.columns
    passages = {tuple(w[j : j + 13]) for r in table(spark, SF, "benchmark").collect() for w in [words(r.text)] for j in range(len(w) - 12)}
    dirty = {r.doc_id for r in one.collect() for w in [words(r.text)] if any(tuple(w[j : j + 13]) in passages for j in range(len(w) - 12))}
    clean = steps["benchmark decontamination"](spark, one, SF).cache()
    left = {r.doc_id for r in clean.collect()}
    found = {r.doc_id for r in decontaminate.contaminated(one, table(spark, SF, "benchmark")).collect()}
    assert dirty and dirty <= found and left == {r.doc_id for r in one.collect()} - found and len(found) <= len(dirty) + 2
    packed = steps["best-fit packing"](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == left
    tokenizer, texts = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {r.doc_id: r.text for r in clean.collect()}
    for r in packed[::20]:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_edges_pass_through_all_stages(spark, edge_docs, no_docs):
    for docs, least in ((edge_docs, 1), (no_docs, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == edge_docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= least


def five_word_kept(rows):
    """Smallest ids of the components at 0.8 on five-word shingles, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return sorted(i for i in sets if root(i) == i)


def test_near_duplicate_stage_against_five_words(spark):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    base = [f"w{i}" for i in range(120)]
    # a tail of a fifth, and a fifteenth of the words replaced in one run: far apart on 4 words at 0.85
    rows = [(1000, " ".join(base)), (1001, " ".join(base + [f"t{i}" for i in range(24)]))]
    rows += [(1002, " ".join(["v" + w for w in base])), (1003, " ".join([f"r{i}" if 50 <= i < 58 else "v" + w for i, w in enumerate(base)]))]
    rows += variants(3, 250)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
    assert kept == five_word_kept(rows) != sorted({c for _, _, c in brute(rows)})
    assert {1000, 1002} <= set(kept) and not {1001, 1003} & set(kept)

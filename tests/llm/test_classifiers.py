import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_kb.llm import quality, toxicity
from corpus_kb.llm.common import fold_of, table

SF = "/root/testdata/sf0.1"


def held_out(spark, scored, column):
    truth = table(spark, SF, "labels").select("doc_id", column)
    rows = scored.where("held_out").join(truth, "doc_id").select("score", "predicted", column).toPandas()
    rank, positive = rows["score"].rank(), rows[column] == 1
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    return rows, float((rows["predicted"] == rows[column]).mean()), float(auc)


def test_quality_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    rows, accuracy, auc = held_out(spark, quality.score(docs, quality.train(docs, table(spark, SF, "labels"))), "quality")
    assert len(rows) > 700 and accuracy > 0.99 and auc > 0.995


def test_toxicity_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows, accuracy, auc = held_out(spark, toxicity.score(docs, model), "toxic")
    assert accuracy > 0.98 and auc > 0.975
    clean = rows[rows["toxic"] == 0]
    assert (clean["predicted"] == 1).mean() < 0.01


def test_folds(spark, edge_docs, edge_labels):
    got = {r.doc_id: r.held_out for r in quality.score(edge_docs, quality.train(edge_docs, edge_labels)).collect()}
    assert all(h == (i is None or fold_of(i) == 0) for i, h in got.items())


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, edge_docs, no_docs, edge_labels, module, column):
    for labels in (edge_labels, edge_labels.limit(0)):
        got = module.score(edge_docs, module.train(edge_docs, labels, column)).collect()
        assert len(got) == 16 and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
        kept = module.keep(edge_docs, module.train(edge_docs, labels, column))
        assert kept.columns == edge_docs.columns and kept.count() <= 16
    model = module.train(no_docs, edge_labels, column)
    assert module.score(no_docs, model).count() == 0 and module.keep(no_docs, model).count() == 0
    assert module.score(edge_docs, model).count() == 16


def test_no_labels_scores_the_middle(edge_docs, edge_labels):
    got = quality.score(edge_docs, quality.train(edge_docs, edge_labels.limit(0))).collect()
    assert {round(r.score, 9) for r in got} == {0.5}


def test_keep_agrees_with_score(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("label", F.lit("x"))
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    forest = quality.train(docs, labels)
    kept = {r.doc_id for r in quality.keep(docs, forest).collect()}
    assert kept == {r.doc_id for r in quality.score(docs, forest).where("predicted = 1").collect()}


def test_forest_traversal_equals_a_walk_of_each_tree():
    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = quality.fit(x, y, trees=12, depth=3)
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.97

    def walk(row):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])


def test_statistics_count_repetition_and_classes():
    one, many = quality.statistics(b"alpha beta gamma delta\n"), quality.statistics(b"alpha beta alpha beta\nalpha beta\n")
    assert len(one) == len(many) == quality.N_STATISTICS == len(quality.statistics(b""))
    assert many[15] > one[15] == 0  # repeated pairs


def test_continuations_against_a_plain_count(spark):
    rows = [(1, "bad word here", 1), (2, "bad word here", 1), (3, "a bad thing", 1), (6, "good word here", 0), (8, "Good, word; good!", 0)]
    rows = [r for r in rows if fold_of(r[0]) in (1, 2, 3)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    want: Counter = Counter()
    for label in (0, 1):
        pairs = set()
        for _, text, y in rows:
            words = toxicity.model_words(text.encode())
            if y == label:
                pairs |= set(zip([None, *words], words, strict=False))
        for _, w in pairs:
            want[toxicity.bucket(w), label] += 1
    got = {}
    for r in toxicity.continuations(docs, known).collect():
        got[r.bucket, 1], got[r.bucket, 0] = r.toxic, r.ordinary
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_kneser_ney_against_plain_arithmetic(spark):
    toxic, ordinary = [5, 0, 1, 0], [50, 20, 0, 0]
    df = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(zip(toxic, ordinary, strict=True))], "bucket int, toxic long, ordinary long")
    ratios, unseen = toxicity.kneser_ney(df.where("toxic + ordinary > 0"), 4)
    got = {r.bucket: r.ratio for r in ratios.collect()} | {3: unseen}
    whole = sum(toxic) + sum(ordinary) + 4 * toxicity.PRIOR
    shared = [(t + o + toxicity.PRIOR) / whole for t, o in zip(toxic, ordinary, strict=True)]
    model = []
    for counts in (toxic, ordinary):
        free = sum(min(c, toxicity.DISCOUNT) for c in counts) / sum(counts)
        model.append([max(c - toxicity.DISCOUNT, 0) / sum(counts) + free * p for c, p in zip(counts, shared, strict=True)])
        assert sum(model[-1]) == pytest.approx(1)
    assert [got[i] for i in range(4)] == pytest.approx([math.log(a / b) for a, b in zip(*model, strict=True)], rel=1e-5)

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts in the tasks that read them. The trees are fitted on the driver from a bounded sample of
labelled rows (``SAMPLE_ROWS``, the smallest hashes of the ids), held-out folds never among them. A fitted model is a few
flat arrays, one row a tree in heap order, so scoring is ``depth`` rounds of numpy indexing a batch.

Rows: null and empty texts have all-zero statistics and are scored like any other; of repeated ids one row is learnt from and
every row is scored; without a label of each class the score is the share of label 1 (0.5 without labels); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_kb.llm.common import arrow_map, binary_text, fold, labelled

#: Bound on the labelled rows that the trees are fitted on.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.15, 1.0, 4.0

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"()-", b"!", b"|/\\_<>{}[]=+~^`", b"#$%&*@"]
_CLASS_OF = np.full(256, len(_CLASSES) + 1, np.uint8)  # the last: bytes outside ASCII
_CLASS_OF[:128] = len(_CLASSES)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _i
N_STATISTICS = len(_CLASSES) + 2 + 11


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes, lengths, and shares of repeated words, word pairs and lines."""
    if not text:
        return [0.0] * N_STATISTICS
    shares = np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 2) / len(text)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    counts, pairs, by_line = Counter(words), len(set(zip(words, words[1:], strict=False))), Counter(lines)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        *shares.tolist(), np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n, (len(words) - 1 - pairs) / n,
        max(counts.values(), default=0) / n, marked / n, sum(len(w) > 12 for w in words) / n, sum(len(x) * (c - 1) for x, c in by_line.items()) / len(text),
        len(text) / m, max(by_line.values(), default=0) / m,
    ]


@dataclass
class Forest:
    """Trees as rows in heap order: a node goes right where its feature is above its threshold; leaves carry values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Second-order boosting of the logistic loss; splits between quantile bins."""
    inner, width = 2**depth - 1, x.shape[1] if x.ndim == 2 else N_STATISTICS
    share = float(y.mean()) if len(y) else 0.5
    none = Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))))
    if not len(y) or share in (0.0, 1.0):
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    features, thresholds, leaves, total = [], [], [], np.full(len(y), none.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            best = np.full(n, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key, size = local * bins + binned[:, f], n * bins
                gs = np.cumsum(np.bincount(key, g, size).reshape(n, bins), 1)
                hs = np.cumsum(np.bincount(key, h, size).reshape(n, bins), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < LEAST) | (ht - hs < LEAST)] = 0
                at = gain[:, : len(e)].argmax(1)
                top = gain[np.arange(n), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], threshold[first + i] = top[i], f, e[at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        local = node - inner
        leaf = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + L2)
        total += leaf[local]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), none.base)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    """Trees for a 0/1 label, from at most ``rows`` labelled documents outside the held-out fold."""
    known = labelled(labels, column).where(fold(F.col("doc_id")) != 0)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).join(F.broadcast(sample), "doc_id")
    counted = arrow_map(rows_of, "doc_id long, label int, x array<double>",
                        lambda b: {"doc_id": b["doc_id"], "label": b["label"], "x": [statistics(t.as_py()) for t in b["text"]]})
    found = counted.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("s")).orderBy("doc_id").select("s.*").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), -1) if len(found) else np.zeros((0, N_STATISTICS))
    return fit(x, found["label"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """Score and decision of every row."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def rows(batch: pa.RecordBatch) -> dict:
        x = np.array([statistics(t.as_py()) for t in batch["text"]], float).reshape(-1, N_STATISTICS)
        value = model.value.score(x)
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": value, "predicted": (value >= threshold).astype(np.int32)}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), binary_text())
    return arrow_map(narrow, "doc_id long, held_out boolean, score double, predicted int", rows)


def keep(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """Rows that the trees accept, with all their columns, in one pass and without a join."""
    from pyspark.sql.types import StructType

    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            x = np.array([statistics((t or "").encode()) for t in texts], float).reshape(-1, N_STATISTICS)
            yield batch.filter(pa.array(model.value.score(x) >= threshold))

    return docs.mapInArrow(run, StructType(docs.schema.fields))

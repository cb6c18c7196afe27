"""Toxicity by class-conditional Kneser-Ney models of letters.

Each class (toxic, ordinary) has an n-gram model over the letters (UTF-8 bytes) of its words. A word's letters count once for every
different word that it follows (``continuations``), so copies of a document add nothing. Absolute discounting frees mass of every context of
``ORDER - 1`` letters (``letter_ratios``), which both classes hand to one shared backoff distribution: interpolated Kneser-Ney of the lower orders over
both classes, from continuation counts, down to single letters and ``1 / 256`` (``lower_orders``). A letter that neither class has seen after a context thus
has the ratio of the masses that the two have left there, a context that neither has seen tells nothing.

A word's log-likelihood ratio is the sum over its letters. A text's figure is the length-normalised log-likelihood difference of a text that takes a
``SHARE`` of its words from the toxic model to one that takes all from the ordinary model; a logistic curve that never falls, fitted on one fold
of bounded size, turns it into a probability.

All labelled rows of folds 1 to 3 are counted; fold 4 calibrates; fold 0 is held out. A gram of 8 bytes is one 64-bit integer, so nothing
is folded together. The model holds 16 bytes a gram and is broadcast; its grams are those of the labelled words' letters, which grow
far slower than the texts.

Rows: null and empty texts have a zero figure and are scored; of repeated ids one row calibrates and every row is counted and
scored; without labels of both classes the score is the share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpus_kb.llm.common import arrow_map, binary_text, fold, labelled, materialize

#: Letters of a gram; eight bytes fill a long.
ORDER = 8
DISCOUNT, PRIOR, SHARE, CALIBRATION_ROWS = 0.75, 4.0, 0.01, 20_000
#: Slots of the bit map of labelled ids.
SLOT_BITS = 23
#: Distinct words that a batch keeps the figure of; bytes of text whose words are looked up together; rows of a batch that leaves a worker. Small, since
#: workers serve later stages and keep what they once took from the system.
KEPT_WORDS, SLICE_BYTES, OUT_ROWS = 30_000, 1 << 17, 50_000
_MARKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
CLASSES = ("toxic", "ordinary")


def model_words(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII marks divide."""
    return text.decode().lower().encode().translate(_MARKS).split()


def bucket(word: bytes) -> int:
    """64-bit key of a word, as Spark's ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def letter_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the letters of all words, one after the other (seven blanks before a word, one after it), and where each word's begin."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    blank = b" " * (ORDER - 1)
    letters = np.frombuffer(b"".join([blank + w + b" " for w in words]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    # a word with its blanks has ORDER letters more than itself; a gram begins at each of the first len + 1
    at = np.arange(int((lengths + 1).sum())) + np.repeat(np.arange(len(words)) * (ORDER - 1), lengths + 1)
    grams = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        grams = grams << np.uint64(8) | letters[at + k]
    return grams, starts


@dataclass
class Ratio:
    """Log-likelihood ratios (toxic to ordinary): of each gram that a class has seen, in ascending order, and of letters unseen after its context."""

    grams: np.ndarray
    ratios: np.ndarray
    unseen: np.ndarray

    def of_grams(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), np.float32)
        asked, where = np.unique(grams, return_inverse=True)
        after = np.minimum(np.searchsorted(self.grams, asked), len(self.grams) - 1)
        before, context = np.maximum(after - 1, 0), asked >> np.uint64(8)
        # grams of one context lie side by side
        out = np.where(self.grams[after] >> np.uint64(8) == context, self.unseen[after], np.where(self.grams[before] >> np.uint64(8) == context, self.unseen[before], np.float32(0)))
        return np.where(self.grams[after] == asked, self.ratios[after], out)[where]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        grams, starts = letter_grams(words)
        return np.add.reduceat(self.of_grams(grams).astype(np.float64), starts) if words else np.zeros(0)

    def _figures(self, texts: list[list[bytes]], known: dict[bytes, float]) -> list[float]:
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list({w for words in texts for w in words if w not in known})
        # of each word: by how much a text with a SHARE of toxic words is likelier to hold it
        known.update(zip(new, np.log1p(SHARE * np.expm1(np.minimum(self.of_words(new), 50.0))).tolist(), strict=True))
        return [math.fsum(map(known.__getitem__, words)) / len(words) if words else 0.0 for words in texts]

    def figures(self, texts: Iterable[bytes]) -> np.ndarray:
        """Length-normalised log-likelihood difference of each text."""
        out: list[float] = []
        known: dict[bytes, float] = {}
        held, size = [], 0
        for text in texts:
            held.append(model_words(text))
            size += len(text)
            if size > SLICE_BYTES:
                out += self._figures(held, known)
                held, size = [], 0
        return np.array(out + self._figures(held, known), float)


@dataclass
class Curve:
    """Probability by a logistic curve over the figure's ``asinh`` in units of ``scale``; it never falls."""

    scale: float
    slope: float
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(x / self.scale) + self.base, -30.0, 30.0)))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> Curve:
    """Platt scaling, with his targets between 0 and 1; without both classes the share of label 1."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    level = Curve(1.0, 0.0, math.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return level
    scale = float(np.median(np.abs(x))) or 1.0
    z = np.stack([np.arcsinh(x / scale), np.ones(len(x))], 1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([0.0, level.base])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30.0, 30.0)))
        w -= np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - target) + 1e-3 * w), -3, 3)
    return Curve(scale, float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else level


def discounted(count: Column, whole: Column, free: Column, shared: Column) -> Column:
    """A class's probability: its discounted count and the freed mass times the shared backoff; the backoff alone where it has seen nothing."""
    return F.when(whole > 0, (F.greatest(count - F.lit(DISCOUNT), F.lit(0.0)) + free * shared) / whole).otherwise(shared)


def freed(count: str) -> Column:
    return F.sum(F.least(F.col(count).cast("double"), F.lit(DISCOUNT)))


def kneser_ney(counts: DataFrame, buckets: int) -> tuple[DataFrame, float]:
    """(bucket, ratio) of symbols without a context, from the continuation counts (bucket, toxic, ordinary), and the ratio of buckets that neither class has seen.

    The shared backoff is the sum of both classes' counts and ``PRIOR``.
    """
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES), *(F.coalesce(freed(c), F.lit(0.0)).alias(f"free_{c}") for c in CLASSES)).first()
    shared = (F.col("toxic") + F.col("ordinary") + F.lit(PRIOR)) / F.lit(float(sums.toxic + sums.ordinary + PRIOR * buckets))
    toxic, ordinary = (discounted(F.col(c), F.lit(float(sums[c])), F.lit(float(sums[f"free_{c}"])), shared) for c in CLASSES)
    left = {c: sums[f"free_{c}"] / sums[c] if sums[c] else 1.0 for c in CLASSES}
    return counts.select("bucket", F.log(toxic / ordinary).cast("float").alias("ratio")), math.log(left["toxic"] / left["ordinary"])


def letter_counts(words: DataFrame) -> DataFrame:
    """(context, gram, toxic, ordinary): how often either class has each gram of letters, from the continuation counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch["word"].to_pylist()
            grams, inverse = np.unique(letter_grams(texts)[0], return_inverse=True)
            times = np.fromiter((len(w) + 1 for w in texts), np.int64, len(texts))
            counts = [np.bincount(inverse, np.repeat(batch[c].to_numpy(), times), len(grams)).astype(np.int64) for c in CLASSES]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *map(pa.array, counts)], names=["gram", *CLASSES])

    found = words.select("word", *CLASSES).mapInArrow(run, "gram long, toxic long, ordinary long")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in CLASSES)).select(F.shiftrightunsigned("gram", 8).alias("context"), "gram", *CLASSES)


def lower_orders(grams: DataFrame, order: int = ORDER - 1) -> DataFrame:
    """(lower, shared): probability of the last of ``order`` letters after those before it, by interpolated Kneser-Ney over both classes.

    Every order counts in how many different letters' company a gram ends a gram of the next order, and backs off to the order below it.
    """
    orders, found = [], grams.select("gram")
    for k in range(order, 0, -1):
        shorter = found.select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).select(F.shiftrightunsigned("gram", 8).alias("context"), "gram")
        # dealt by context: grams are counted and contexts summed where they lie
        found = shorter.repartition("context").groupBy("context", "gram").agg(F.count(F.lit(1)).alias("n"))
        orders.append((k, found))
    below = None
    for k, found in reversed(orders):
        within = Window.partitionBy("context")
        own = found.select("gram", F.sum("n").over(within).alias("whole"), "n", F.count(F.lit(1)).over(within).alias("kinds"))
        if below is None:
            own = own.withColumn("shared", F.lit(1 / 256))
        else:
            own = own.withColumn("lower", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "lower")
        below = own.select(F.col("gram").alias("lower"), ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("shared")) / F.col("whole")).alias("shared"))
    return below


def letter_ratios(counts: DataFrame, lower: DataFrame) -> DataFrame:
    """(gram, ratio, unseen): log ratio of the classes for a seen gram, and for letters that neither has seen after its context."""
    within = Window.partitionBy("context")
    sums = {c: (F.sum(c).over(within).cast("double").alias(f"whole_{c}"), freed(c).over(within).alias(f"free_{c}")) for c in CLASSES}
    held = counts.select("gram", *CLASSES, *sums["toxic"], *sums["ordinary"], F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)).alias("lower")).join(lower, "lower")
    toxic, ordinary = (discounted(F.col(c), F.col(f"whole_{c}"), F.col(f"free_{c}"), F.col("shared")) for c in CLASSES)
    left = {c: F.when(F.col(f"whole_{c}") > 0, F.col(f"free_{c}") / F.col(f"whole_{c}")).otherwise(1.0) for c in CLASSES}
    return held.select("gram", F.log(toxic / ordinary).cast("float").alias("ratio"), F.log(left["toxic"] / left["ordinary"]).cast("float").alias("unseen"))


def _slots(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def maybe_known(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that may have a label, by one bit for ``2**SLOT_BITS`` slots of ids: texts without a label need not be shuffled to the join."""
    slots = known.select("doc_id").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(b["doc_id"].to_numpy())))], names=["slot"]) for b in batches), "slot long").distinct()
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[slots.toArrow()["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(bits[_slots(batch["doc_id"].to_numpy())].astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def continuations(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(word, bucket, toxic, ordinary): after how many different words (or at a text's start) each word occurs in either class.

    The words before are told apart by 64 bits of their hash, the words themselves as they are.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, int] = {}
            found: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for label, text in zip(batch["label"].to_pylist(), batch["text"], strict=True):
                words = model_words(text.as_py())
                if words:
                    own = np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words))
                    found[label].append(np.unique(own << 32 | np.concatenate([[0], own[:-1]])))
            names, keys = pa.array([b"", *ids], pa.binary()), np.array([0, *map(bucket, ids)], np.int64)
            for label, parts in found.items():
                pair = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                for k in range(0, len(pair), OUT_ROWS):
                    own, left = pair[k : k + OUT_ROWS] >> 32, pair[k : k + OUT_ROWS] & 0xFFFFFFFF
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(keys[left]), pa.array(np.full(len(own), label, np.int32))], names=["word", "left", "label"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).where(F.col("doc_id").isNotNull() & fold(F.col("doc_id")).between(1, 3))
    # a merge join at every size: it spills, and never depends on how many labels there are
    rows = maybe_known(texts, known).join(known.hint("merge"), "doc_id").select("label", "text")
    seen = rows.mapInArrow(pairs, "word binary, left long, label int").groupBy("word", "left").agg(
        F.max(F.col("label")).alias("toxic"), (1 - F.min(F.col("label"))).alias("ordinary"))
    return seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).select("word", F.xxhash64("word").alias("bucket"), *CLASSES)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = CALIBRATION_ROWS) -> tuple[Ratio, Curve]:
    known = labelled(labels, column)
    folded = fold(F.col("doc_id"))
    counts = materialize(letter_counts(continuations(docs, known.where(folded.between(1, 3)))), "letters")
    found = letter_ratios(counts, lower_orders(counts)).toArrow()
    grams = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    ratio = Ratio(grams[order], found["ratio"].to_numpy()[order], found["unseen"].to_numpy()[order])
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    sample = known.where(folded == 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).join(F.broadcast(sample), "doc_id")
    counted = arrow_map(chosen, "doc_id long, label int, x double",
                        lambda b: {"doc_id": b["doc_id"], "label": b["label"], "x": shared.value.figures(t.as_py() for t in b["text"])})
    figures = counted.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("s")).orderBy("doc_id").select("s.*").toPandas()
    shared.unpersist()
    return ratio, calibrate(figures["x"].to_numpy(float), figures["label"].to_numpy(float))


def score(docs: DataFrame, model: tuple[Ratio, Curve], threshold: float = 0.5) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> dict:
        ratio, curve = shared.value
        value = curve.score(ratio.figures(t.as_py() for t in batch["text"]))
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": value, "predicted": (value >= threshold).astype(np.int32)}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), binary_text())
    return arrow_map(narrow, "doc_id long, held_out boolean, score double, predicted int", rows)


def keep(docs: DataFrame, model: tuple[Ratio, Curve], threshold: float = 0.5) -> DataFrame:
    """Rows that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, curve = shared.value
        for batch in batches:
            x = ratio.figures((t.as_py() or "").encode() for t in batch["text"])
            yield batch.filter(pa.array(curve.score(x) < threshold))

    return docs.mapInArrow(run, StructType(docs.schema.fields))

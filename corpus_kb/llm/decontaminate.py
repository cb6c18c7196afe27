"""Benchmark decontamination by spaced seeds.

A seed is the hash of a window of words under a fixed mask; positions that the mask leaves out may differ, so a passage whose words
were exchanged here and there still shares seeds with its benchmark item. Seeds of documents are joined with those of the
benchmark inside the tasks that read the documents. Around each hit the two texts are laid side by side and counted as an
overlap where, in some window of ``OVERLAP`` words (the whole item if that is shorter), at least ``EQUAL`` of the words agree.
The masks of a window length are chosen by rule so that every set of words that may differ is left out by one of them: no such
overlap is without a seed. Letters of scripts without spaces are words of their own.

The benchmark is held in blocks of about ``BLOCK_WORDS`` words, one pass over the documents a block and one block at a time, so the
memory of a task is bounded whatever its size. Equal items are indexed once, and all hits of a stretch of text are verified together.
``least`` leaves out items of fewer words, which are no passage; it is off unless given.

Rows: null and empty texts on either side match nothing; equal items are reported each; repeated documents are reported each; items with a null
id are searched and reported with null; empty tables give no rows (or leave the documents as they are).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpus_kb.llm.common import binary_text, materialize
from corpus_kb.llm.toxicity import model_words

OVERLAP, EQUAL, LEAST, BLOCK_WORDS = 13, 0.8, 5, 500_000
#: Words that a mask compares, by the length of the window. Shorter windows may not differ and are compared whole.
WEIGHTS = {5: 3, 6: 4, 7: 5, 8: 6, 9: 6, 10: 5, 11: 6, 12: 6, 13: 7}
#: Thai, Lao, Myanmar, Khmer, kana, Han: written without spaces.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: Words hashed at a time, hits and words compared at a time, slots of the bit map that most seeds stop at.
CHUNK_WORDS, SLICE, SLOT_BITS, KEPT_WORDS = 200_000, 2_000_000, 24, 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNSPACED = re.compile(f"[{UNSPACED}]")
HITS = "doc_id long, item_id long, matched int, item_words int, first_word long, last_word long"


def passage_words(text: bytes) -> list[bytes]:
    if not text.isascii() and _UNSPACED.search(s := text.decode()):
        text = _UNSPACED.sub(r" \g<0> ", s).encode()
    return model_words(text)


def needed(window: int) -> int:
    """Words of a window that have to agree."""
    return math.ceil(EQUAL * window - 1e-9)


@lru_cache
def masks(window: int) -> tuple[str, ...]:
    """Masks (1 compares a word, 0 leaves it out) that between them, laid anywhere inside the window, leave out every set of
    words that may differ: the mask that covers most sets still open comes next, the shortest of equal ones."""
    weight = WEIGHTS.get(window)
    if weight is None:
        return ("1" * window,)
    left = set(combinations(range(window), window - needed(window)))
    known = []
    for span in range(weight, window + 1):
        for inner in combinations(range(1, span - 1), weight - 2):
            at = (0, *inner, span - 1)
            places = [{i + k for i in at} for k in range(window - span + 1)]
            known.append((at, {x for x in left if any(p.isdisjoint(x) for p in places)}))
    chosen = []
    while left:
        at, covers = max(known, key=lambda c: len(c[1] & left))
        left = left - covers
        chosen.append("".join("1" if i in at else "0" for i in range(at[-1] + 1)))
    return tuple(chosen)


class Words:
    """64-bit hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words, known = passage_words(text), self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of the mask's length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 1000 + int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ hashes[i : i + n]) * _ODD
            out ^= out >> np.uint64(29)
    return out


class Index:
    """Seeds of one block of the benchmark. Items of equal words are one entry with all their ids."""

    def __init__(self, items: list[tuple[int | None, bytes]], least: int = LEAST) -> None:
        words, same = Words(), {}
        for i, t in items:
            if len(h := words.of(t)) >= max(1, least):
                same.setdefault(h.tobytes(), []).append(i)
        self.ids = list(same.values())
        held = [np.frombuffer(h, np.uint64) for h in same]
        self.size = np.array([len(h) for h in held], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.masks = sorted({m for n in set(np.minimum(self.size, OVERLAP).tolist()) for m in masks(n)})
        seed, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, h in enumerate(held):
            for mask in masks(min(len(h), OVERLAP)):
                s = seeds(h, mask)
                seed.append(s)
                item.append(np.full(len(s), k))
                at.append(np.arange(len(s)))
        joined = np.concatenate(seed)
        order = np.argsort(joined, kind="stable")
        self.seed, self.item, self.at = joined[order], np.concatenate(item)[order], np.concatenate(at)[order]
        bits = np.zeros(1 << SLOT_BITS, bool)
        bits[(self.seed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
        self.bits = np.packbits(bits)

    def hits(self, hashes: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        """Different (text, item, diagonal) rows of equal seeds, a bounded number at a time; the diagonal is the place in the text less
        that in the item."""
        for mask in self.masks:
            s = seeds(hashes, mask)
            may = np.flatnonzero(bits[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
            low = np.searchsorted(self.seed, s[may], "left")
            n = np.searchsorted(self.seed, s[may], "right") - low
            text = np.searchsorted(starts, may, "right") - 1
            inside = (n > 0) & (may + len(mask) <= starts[text + 1])
            may, low, n, text = may[inside], low[inside], n[inside], text[inside]
            for a, b in slices(n):
                entry = np.repeat(low[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b]) + np.arange(n[a:b].sum())
                found = np.stack([np.repeat(text[a:b], n[a:b]), self.item[entry], np.repeat((may - starts[text])[a:b], n[a:b]) - self.at[entry]])
                yield distinct(found)

    def overlaps(self, hashes: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
        """(text, item, equal words, first, last + 1) of the windows along each diagonal that agree enough."""
        text, item, diagonal = found
        window = np.minimum(self.size[item], OVERLAP)
        low = np.maximum(0, -diagonal)
        n = np.minimum(self.size[item], (starts[1:] - starts[:-1])[text] - diagonal) - low
        fits = n >= window
        text, item, diagonal, window, low, n = (x[fits] for x in (text, item, diagonal, window, low, n))
        out = [np.zeros((5, 0), np.int64)]
        for a, b in slices(n):
            size, w = n[a:b], window[a:b]
            begin = np.cumsum(size) - size
            row = np.repeat(np.arange(b - a), size)
            step = np.arange(len(row)) - begin[row]
            equal = self.words[(self.start[item[a:b]] + low[a:b])[row] + step] == hashes[(starts[text[a:b]] + diagonal[a:b] + low[a:b])[row] + step]
            sums = np.concatenate([[0], np.cumsum(equal)])
            may = np.flatnonzero(step <= (size - w)[row])
            good = may[sums[may + w[row[may]]] - sums[may] >= np.ceil(EQUAL * w - 1e-9)[row[may]]]
            rows, first = np.unique(row[good], return_index=True)
            if len(rows):
                start, last = good[first], good[np.append(first[1:], len(good)) - 1] + w[rows]
                place = (diagonal[a:b] + low[a:b] - begin)[rows]
                out.append(np.stack([text[a:b][rows], item[a:b][rows], sums[last] - sums[start], place + start, place + last]))
        return np.concatenate(out, axis=1)

    def rows(self, texts: list[bytes], words: Words, bits: np.ndarray) -> Iterator[tuple[int, int | None, int, int, int, int]]:
        """(number of the text, item id, equal words, words of the item, first, last + 1): the best overlap with each item."""
        held: list[np.ndarray] = []
        first = size = 0
        for k, text in enumerate([*texts, None]):
            if text is not None:
                held.append(words.of(text))
                size += len(held[-1])
            if held and (text is None or size >= CHUNK_WORDS):
                starts = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
                joined = np.concatenate(held)
                best = np.zeros((5, 0), np.int64)
                for found in self.hits(joined, starts, bits):
                    best = np.concatenate([best, self.overlaps(joined, starts, found)], axis=1)
                    # the last of equal (text, item) has most equal words, then the latest place
                    best = best[:, np.lexsort(best[[4, 3, 2, 1, 0]])]
                    best = best[:, np.append((best[:2, 1:] != best[:2, :-1]).any(0), True)[: best.shape[1]]]
                for d, item, n, a, b in best.T.tolist():
                    for i in self.ids[item]:
                        yield first + d, i, n, int(self.size[item]), a, b
                held, first, size = [], first + len(held), 0


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most ``SLICE``; a larger row stands alone."""
    sums, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sums, SLICE + (sums[a - 1] if a else 0), "right")))
        yield a, b
        a = b


def distinct(columns: np.ndarray) -> np.ndarray:
    columns = columns[:, np.lexsort(columns[::-1])]
    return columns[:, np.append(True, (columns[:, 1:] != columns[:, :-1]).any(0))[: columns.shape[1]]]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, least: int | None = None) -> Iterator[Index]:
    """Indexes of bounded size that together hold the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), binary_text())
    # runs of letters and digits, and letters of unspaced scripts one by one, as the index counts them
    pattern = f"[{UNSPACED}]|[^\\x00-/:-@\\[-`{{-\x7f{UNSPACED}]+"
    words = items.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(pattern)))).first()[0] or 0
    n = -(-words // block_words)
    for b in range(n):
        found = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").toArrow() if n > 1 else items.orderBy("item_id", "text").toArrow()
        yield Index(list(zip(found["item_id"].to_pylist(), found["text"].to_pylist(), strict=True)), least or 1)


def _with_block(docs: DataFrame, index: Index, schema: str | StructType, make: Callable) -> DataFrame:
    """``make`` turns a batch and the rows of its overlaps into a batch of ``schema``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = shared.value, Words()
        bits = np.unpackbits(index.bits).astype(bool)
        for batch in batches:
            texts = [t if isinstance(t, bytes) else (t or "").encode() for t in batch["text"].to_pylist()]
            yield make(batch, index.rows(texts, words, bits))

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least: int | None = None) -> DataFrame:
    """One row for each document and item that overlap. Of several blocks each one's rows are written before the next is built."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text())
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("item_words", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def listed(batch: pa.RecordBatch, rows) -> pa.RecordBatch:
        ids = batch["doc_id"].to_pylist()
        columns = list(zip(*((ids[k], *rest) for k, *rest in rows), strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    parts: list[DataFrame] = []
    last = None
    for index in blocks(benchmark, block_words, least):
        if last is not None:
            parts.append(materialize(last, "overlaps"))
        last = _with_block(narrow, index, HITS, listed)
    if last is None:
        return docs.sparkSession.createDataFrame([], HITS)
    return reduce(DataFrame.unionByName, [*parts, last if not parts else materialize(last, "overlaps")])


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least: int | None = None) -> DataFrame:
    """Documents that overlap with no item, with all their columns.

    A benchmark of one block filters the documents where they are read. Of more blocks, each leaves the digests of the texts that
    overlap, and documents with such a text go: documents are never rewritten for a block.
    """
    digest = pa.schema([("digest", pa.string())])

    def stay(batch: pa.RecordBatch, rows) -> pa.RecordBatch:
        kept = np.ones(batch.num_rows, bool)
        kept[[k for k, *_ in rows]] = False
        return batch.filter(pa.array(kept))

    def digests(batch: pa.RecordBatch, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["digest"].take(pa.array(sorted({k for k, *_ in rows}), pa.int64()))], schema=digest)

    found = blocks(benchmark, block_words, least)
    one, more = next(found, None), next(found, None)
    if one is None:
        return docs
    if more is None:
        return _with_block(docs, one, docs.schema, stay)
    of_text = F.sha2(binary_text(), 256)
    narrow, parts = docs.select(of_text.alias("digest"), binary_text()), []
    for first in (one, more):
        parts.append(materialize(_with_block(narrow, first, "digest string", digests), "overlaps"))
    del one, more, first
    for index in found:
        parts.append(materialize(_with_block(narrow, index, "digest string", digests), "overlaps"))
    gone = reduce(DataFrame.unionByName, parts).distinct()
    return docs.join(gone, of_text == gone["digest"], "left_anti").select(*docs.columns)

"""Phrase collocations by weighted acyclic automata.

Every word position of a piece gives one path: the words from there on, at most ``LONGEST``. A path's sorted prefix range holds all
occurrences of a phrase, so a phrase's count is the sum of the weights below its prefix, and one path serves all lengths.

1. Words are counted, then pairs (steps 2 and 3 with paths of two words); a path ends before the first word and between the first two words that occur
   in fewer than ``LEAST`` places, since no candidate holds them. Both are looked up in bit maps of a fixed size, whatever their number; a bit set in
   vain keeps a path longer and changes no result.
2. Each task collects a *shard* of paths, sorts them and builds, level by level from the ends, the minimal transducer of paths and counts: states with equal arcs,
   targets and weights are one. A shard is cut at the bounds of the prefix ranges and goes to their tasks as a few compressed arrays.
3. The task of a range unites the shards' transducers, adding weights, and sums them by prefix. A phrase whose paths lie in several ranges is a prefix of
   the first or last path there; such partial sums are passed on whatever their size and added up.
4. The phrases that occur often enough become transducers of their own, by hash buckets. The two parts of every cut of a candidate are composed
   with them; a bucket with many requests is split and its transducer, of bounded size, goes to each split.

A longer phrase never occurs more often than one inside it, so a candidate is inside a longer one of equal count just if it is the first or
the second part of one that is a word longer. Scores are whole numbers in decimals of 38 digits.

Rows: null and empty texts have no words; a null language counts as ``und``; repeated rows count each; a language without candidates gives no rows, and neither does an
empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_kb.llm.common import materialize, small_batches

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of the maps of frequent words and pairs: 2 and 8 MB.
WORD_BITS, PAIR_BITS = 24, 26
#: Words of a shard; word positions a prefix range; documents and paths of the sample that bounds the ranges; phrases a bucket, requests a split.
SHARD_WORDS, RANGE_WORDS, SAMPLE_DOCS, SAMPLE_PATHS, BUCKET_PHRASES, SPLIT_REQUESTS = 1_000_000, 1_000_000, 5000, 50_000, 50_000, 500_000
#: Bytes of a word up to which a sampled path may bound a range.
BOUND_BYTES = 64
_MARK = b"."
_FOLD = bytes(ord(".") if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def piece_words(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``.`` between and behind pieces."""
    return [*text.translate(_FOLD).replace(_MARK, b" . ").split(), _MARK]


@dataclass
class Transducer:
    """Paths of equally many labels (0 behind the end) to weights; labels number ``words`` from 1.

    Level d has states ``0 .. len(first[d]) - 2``; arcs ``first[d][s] : first[d][s + 1]`` leave state s, sorted by label. The last level's
    arcs carry the weights.
    """

    words: list[bytes]
    first: list[np.ndarray]
    label: list[np.ndarray]
    target: list[np.ndarray]
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.weight)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in order, and their weights."""
        state, columns, arc = np.zeros(1, np.int64), [], np.zeros(0, np.int64)
        for first, label, target in zip(self.first, self.label, self.target, strict=True):
            n = (first[state + 1] - first[state]).astype(np.int64)
            arc = np.repeat(first[state].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
            columns = [np.repeat(c, n) for c in columns] + [label[arc]]
            state = target[arc].astype(np.int64)
        return np.stack(columns, 1), self.weight[arc]

    def weights_of(self, paths: np.ndarray) -> np.ndarray:
        """Weight of each given path by following its arcs; 0 for paths that are not accepted."""
        state, live, arc = np.zeros(len(paths), np.int64), np.ones(len(paths), bool), np.zeros(len(paths), np.int64)
        for d, (first, label, target) in enumerate(zip(self.first, self.label, self.target, strict=True)):
            of = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 32 | label
            wanted = state << 32 | paths[:, d]
            arc = np.minimum(np.searchsorted(of, wanted), len(of) - 1)
            live &= of[arc] == wanted
            state = np.where(live, target[arc], 0).astype(np.int64)
        return np.where(live, self.weight[arc], 0)

    def pack(self) -> bytes:
        arrays = [a.astype(np.int32) for level in zip(self.first, self.label, self.target, strict=True) for a in level] + [self.weight.astype(np.int64).view(np.int32)]
        words = b"\t".join(self.words)
        head = np.array([len(words), *map(len, arrays)], np.int64)
        return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(head)], np.int64).tobytes(), head.tobytes(), words, *(a.tobytes() for a in arrays)]))

    @classmethod
    def unpack(cls, packed: bytes) -> Transducer:
        data = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, n, 8).tolist()
        at = 8 * (n + 1) + head[0]
        words, arrays = data[8 * (n + 1) : at].split(b"\t"), []
        for size in head[1:]:
            arrays.append(np.frombuffer(data, np.int32, size, at))
            at += 4 * size
        weight = np.frombuffer(arrays.pop().tobytes(), np.int64)
        return cls(words, arrays[0::3], arrays[1::3], arrays[2::3], weight)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    out = np.full(len(columns[0]), _M3, np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * _M1
        out = (out ^ (out >> np.uint64(29))) * _M2
        out ^= out >> np.uint64(32)
    return out


def fresh_prefixes(paths: np.ndarray) -> list[np.ndarray]:
    """For each length from 0, where in sorted paths a prefix of that length begins."""
    starts = np.zeros(len(paths), bool)
    starts[:1] = True
    out = [starts]
    for d in range(paths.shape[1]):
        starts = starts.copy()
        starts[1:] |= paths[1:, d] != paths[:-1, d]
        out.append(starts)
    return out


def build(words: list[bytes], paths: np.ndarray, weight: np.ndarray) -> Transducer:
    """Minimal transducer of sorted, different paths."""
    used = np.unique(paths)
    used = used[used > 0]
    renumber = np.zeros(len(words) + 1, np.int64)
    renumber[used] = np.arange(1, len(used) + 1)
    fresh, paths = fresh_prefixes(paths), renumber[paths]
    firsts, labels, targets, weights = [], [], [], weight
    target = np.zeros(len(paths), np.int64)
    for d in range(paths.shape[1] - 1, -1, -1):
        rows = np.flatnonzero(fresh[d + 1])
        label, start = paths[rows, d], np.flatnonzero(fresh[d][rows])
        carried = weights if d == paths.shape[1] - 1 else np.zeros(len(rows), np.int64)
        count = np.diff(np.append(start, len(rows)))
        signature = np.add.reduceat(_mixed(label, target, carried), start) if len(start) else np.zeros(0, np.uint64)
        _, chosen, state = np.unique(signature, return_index=True, return_inverse=True)
        # states of equal signature are one if their arcs are equal indeed
        of = np.repeat(np.arange(len(start)), count)
        same_count = (count == count[chosen][state]).all()
        twin = start[chosen[state]][of] + np.arange(len(rows)) - start[of] if same_count else None
        if twin is None or not ((label[twin] == label).all() and (target[twin] == target).all() and (carried[twin] == carried).all()):
            chosen = state = np.arange(len(start))
        n = count[chosen]
        arc = np.repeat(start[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
        firsts.append(np.append(0, np.cumsum(n)))
        labels.append(label[arc])
        targets.append(target[arc])
        if d == paths.shape[1] - 1:
            weights = carried[arc]
        target = state
    return Transducer([words[i - 1] for i in used.tolist()], firsts[::-1], labels[::-1], targets[::-1], weights)


def summed(paths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different paths with the sums of their weights; labels stay below 2**21."""
    wide = np.zeros((len(paths), 6), np.int64)
    wide[:, : paths.shape[1]] = paths
    high, low = (wide[:, i] << 42 | wide[:, i + 1] << 21 | wide[:, i + 2] for i in (0, 3))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    head = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(order)])
    return paths[order[head]], np.add.reduceat(weight[order], head) if len(head) else weight[:0]


def union(parts: list[Transducer]) -> Transducer:
    """One transducer of all paths, weights added."""
    if len(parts) == 1:
        return parts[0]
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: i for i, w in enumerate(words, 1)}
    found = [p.paths() for p in parts]
    paths = np.concatenate([np.array([0, *map(number.__getitem__, p.words)], np.int64)[x] for p, (x, _) in zip(parts, found, strict=True)])
    return build(words, *summed(paths, np.concatenate([w for _, w in found])))


def prefix_sums(t: Transducer, least: int) -> tuple[list[bytes], list[int], list[int]]:
    """Phrases, their lengths and counts within a range: those with ``least`` or more, and those that other ranges may hold more of."""
    paths, weight = t.paths()
    out: tuple[list, list, list] = ([], [], [])
    for k, starts in enumerate(fresh_prefixes(paths)[1:], 1):
        at = np.flatnonzero(starts)
        sums = np.add.reduceat(weight, at)
        open_ = np.zeros(len(at), bool)
        open_[[0, -1]] = True
        keep = (paths[at, k - 1] > 0) & ((sums >= least) | open_)
        for row, total in zip(paths[at[keep], :k].tolist(), sums[keep].tolist(), strict=True):
            out[0].append(b" ".join(t.words[i - 1] for i in row))
            out[1].append(k)
            out[2].append(total)
    return out


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                counts.setdefault(lang, Counter()).update(piece_words(text.as_py()))
            for lang, found in counts.items():
                found.pop(_MARK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    return texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of word pairs from their words' hashes."""
    x = (first * _M1 ^ second) * _M2
    return x ^ (x >> np.uint64(31))


def phrase_hashes(phrases: list[bytes]) -> np.ndarray:
    """Hashes of words or pairs."""
    first = np.array([word_hash(p.split(b" ")[0]) for p in phrases], np.uint64)
    two = [p.split(b" ")[1:] for p in phrases]
    second = np.array([word_hash(w[0]) if w else 0 for w in two], np.uint64)
    return np.where(np.array([bool(w) for w in two], bool), pair_hash(first, second), first)


def bit_map(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of words or pairs (column ``phrase``), packed in the tasks: ``2**bits / 8`` bytes whatever their number."""
    block = 15

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(phrase_hashes([x.as_py().encode() for x in batch["phrase"]]) & np.uint64((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> block), pa.array((slots & ((1 << block) - 1)).astype(np.int32))], names=["block", "slot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch["slots"]:
                x = np.zeros(1 << block, bool)
                x[found.values.to_numpy()] = True
                out.append(np.packbits(x, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(out, pa.binary())], names=["block", "bits"])

    grouped = phrases.select("phrase").mapInArrow(place, "block long, slot int").groupBy("block").agg(F.collect_set("slot").alias("slots"))
    whole = np.zeros((1 << (bits - block), (1 << block) // 8), np.uint8)
    for row in grouped.mapInArrow(pack, "block long, bits binary").toLocalIterator():
        whole[row.block] = np.frombuffer(row.bits, np.uint8)
    return whole.ravel()


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


class _Numbers(dict):
    """Numbers of a shard's words in order of appearance; 0 for marks and for words that are too rare."""

    def __init__(self, often: np.ndarray) -> None:
        super().__init__({_MARK: 0})
        self.often, self.last = often, 8 * len(often) - 1
        self.words: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        slot, n = h & self.last, 0
        if self.often[slot >> 3] >> (slot & 7) & 1:
            self.words.append(word)
            self.hashes.append(h)
            n = len(self.words)
        self[word] = n
        return n


def shard_paths(tokens: np.ndarray, positions: int, longest: int = LONGEST, joined: np.ndarray | None = None) -> np.ndarray:
    """One row a word position below ``positions``: the labels from there up to the next 0, at most ``longest``.

    ``joined`` says of each position whether it may go on to the next; rows of one word are left out then.
    """
    padded = np.concatenate([tokens, np.zeros(longest, tokens.dtype)])
    at = np.flatnonzero((tokens[:positions] > 0) & (True if joined is None else joined[:positions]))
    paths = np.zeros((len(at), longest), tokens.dtype)
    paths[:, 0] = tokens[at]
    live = np.ones(len(at), bool)
    for i in range(1, longest):
        if joined is not None:
            live &= joined[np.minimum(at + i - 1, len(joined) - 1)]
        paths[:, i] = padded[at + i] * live
        live &= paths[:, i] > 0
    return paths


class Shard:
    """Word numbers of a task's texts by language, on their way into transducers."""

    def __init__(self, often: np.ndarray, pairs: np.ndarray | None = None, longest: int = LONGEST) -> None:
        self.often, self.pairs, self.longest, self.size = often, pairs, longest, 0
        self.numbers: dict[str, _Numbers] = {}
        self.tokens: dict[str, list[np.ndarray]] = {}

    def add(self, lang: str, text: bytes) -> None:
        words = piece_words(text)
        if lang not in self.numbers:
            self.numbers[lang], self.tokens[lang] = _Numbers(self.often), []
        self.tokens[lang].append(np.fromiter(map(self.numbers[lang].__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def paths(self, lang: str, most: int = SHARD_WORDS) -> Iterator[np.ndarray]:
        """A language's paths in numbers, parts of ``most`` positions."""
        tokens = np.concatenate(self.tokens[lang])
        hashes = np.array([0, *self.numbers[lang].hashes], np.uint64)
        for at in range(0, len(tokens), most):
            part = tokens[at : at + most + self.longest - 1]
            joined = None
            if self.pairs is not None:
                joined = np.append((part[:-1] > 0) & (part[1:] > 0), False)
                go = np.flatnonzero(joined)
                joined[go] = holds(self.pairs, pair_hash(hashes[part[go]], hashes[part[go + 1]]))
            yield shard_paths(part, most, self.longest, joined)

    def sorted_paths(self, most: int = SHARD_WORDS) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """Language, its words in order, sorted different paths and their counts."""
        for lang in self.tokens:
            words = self.numbers[lang].words
            order = sorted(range(len(words)), key=words.__getitem__)
            rank = np.zeros(len(words) + 1, np.int64)
            rank[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
            for paths in self.paths(lang, most):
                if len(paths):
                    yield lang, [words[i] for i in order], *summed(rank[paths], np.ones(len(paths), np.int64))


def range_bounds(docs: DataFrame, empty_shard: Callable[[], Shard], ranges: int, sample_docs: int = SAMPLE_DOCS, sample_paths: int = SAMPLE_PATHS) -> dict[str, list[tuple]]:
    """By language, the sorted paths at which a range begins, and how many ranges lie before; from a bounded sample, which moves work only."""
    stride = 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                shard = empty_shard()
                shard.add(lang, text.as_py())
                words = shard.numbers[lang].words
                for row in (row for paths in shard.paths(lang) for row in paths[::stride].tolist()):
                    path = [words[i - 1] for i in row if i]
                    if max(map(len, path)) <= BOUND_BYTES:
                        out.append((lang, b"\t".join(path)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["lang", "path"])

    narrow = texts(docs)
    n = max(1, docs.count())
    chosen = narrow.sample(min(1.0, 2 * sample_docs / n), 7).limit(sample_docs) if n > sample_docs else narrow
    found = chosen.mapInArrow(run, "lang string, path binary").orderBy(F.xxhash64("path"), "path", "lang").limit(sample_paths).collect()
    every = sorted((r.lang, tuple(bytes(r.path).split(b"\t"))) for r in found)
    cuts = sorted({every[i * len(every) // ranges] for i in range(1, ranges)}) if every else []
    out: dict[str, list] = {}
    for lang in {x for x, _ in every}:
        mine = [p for x, p in cuts if x == lang]
        out[lang] = [sum(x < lang for x, _ in cuts), mine]
    return out


def shards(docs: DataFrame, empty_shard: Callable[[], Shard], bounds) -> DataFrame:
    """(range, lang, packed) of each task's transducers, cut at the bounds of the ranges."""

    def flush(shard: Shard) -> pa.RecordBatch:
        rows = []
        for lang, words, paths, counts in shard.sorted_paths():
            base, mine = bounds.value.get(lang, (0, []))
            cuts = [bisect_left(range(len(paths)), b, key=lambda i: tuple(words[j - 1] for j in paths[i] if j)) for b in mine]
            for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(paths)], strict=True)):
                if lo < hi:
                    rows.append((base + i, lang, build(words, paths[lo:hi], counts[lo:hi]).pack()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary()))], names=["range", "lang", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = empty_shard()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                shard.add(lang, text.as_py())
                if shard.size >= SHARD_WORDS:
                    yield flush(shard)
                    shard = empty_shard()
        yield flush(shard)

    return texts(docs).mapInArrow(run, "range int, lang string, packed binary")


def _unite(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of phrases from transducers that come sorted by range and language."""
    key, held, size = None, [], 0

    def flush() -> pa.RecordBatch:
        phrases, lengths, counts = prefix_sums(union(held), least)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[1]] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "k", "f"])

    for batch in batches:
        for now, packed in zip(zip(batch["range"].to_pylist(), batch["lang"].to_pylist(), strict=True), batch["packed"], strict=True):
            if now != key and held:
                yield flush()
                held, size = [], 0
            key = now
            held.append(Transducer.unpack(packed.as_py()))
            size += len(held[-1])
            if size > 2 * RANGE_WORDS and len(held) > 8:
                held = [union(held)]
                size = len(held[0])
    if held:
        yield flush()


def counted(docs: DataFrame, empty_shard: Callable[[], Shard], least: int, ranges: int, name: str) -> DataFrame:
    """(lang, phrase, k, f) of all prefixes of the shards' paths that occur ``least`` times or more."""
    bounds = docs.sparkSession.sparkContext.broadcast(range_bounds(docs, empty_shard, ranges))
    cut = shards(docs, empty_shard, bounds)
    with small_batches(docs.sparkSession, 64):
        found = materialize(
            cut.repartition(ranges, "range").sortWithinPartitions("range", "lang").mapInArrow(partial(_unite, least=least), "lang string, phrase string, k int, f long"), name)
    bounds.unpersist()
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, ranges: int | None = None, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of up to ``LONGEST`` words that occur ``least`` times or more."""
    context = docs.sparkSession.sparkContext
    frequent = words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("f"))
    often = context.broadcast(bit_map(frequent, word_bits))
    total = words.agg(F.sum("n")).first()[0] or 0
    ranges = ranges or max(context.defaultParallelism, -(-total // RANGE_WORDS))
    two = counted(docs, lambda: Shard(often.value, longest=2), least, ranges, "pairs").where("k = 2")
    pairs = context.broadcast(bit_map(two, pair_bits))
    found = counted(docs, lambda: Shard(often.value, pairs.value), least, ranges, "ranges")
    for shared in (often, pairs):
        shared.unpersist()
    return frequent.unionByName(found.where("k > 1"))


def _numbered(words: list[bytes], phrases: list[bytes]) -> np.ndarray:
    """Paths of phrases; -1 for words that are not known."""
    number = {w: i for i, w in enumerate(words, 1)}
    out = np.zeros((len(phrases), LONGEST), np.int64)
    for i, phrase in enumerate(phrases):
        found = [number.get(w, -1) for w in phrase.split(b" ")]
        out[i, : len(found)] = found
    return out


def _transducers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A packed transducer for each run of (bucket, lang)."""
    rows = ((b, lang, p.encode(), f) for batch in batches for b, lang, p, f in zip(*(batch[c].to_pylist() for c in ("bucket", "lang", "phrase", "f")), strict=True))
    for (bucket, lang), group in groupby(rows, key=lambda r: r[:2]):
        mine = list(group)
        words = sorted({w for r in mine for w in r[2].split(b" ")})
        paths, weight = summed(_numbered(words, [r[2] for r in mine]), np.array([r[3] for r in mine], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([lang]), pa.array([build(words, paths, weight).pack()], pa.binary())], names=["bucket", "lang", "packed"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of requested parts; the transducers of a split come ahead of its requests."""
    place, held = None, {}
    for batch in batches:
        places = list(zip(batch["bucket"].to_pylist(), batch["split"].to_pylist(), strict=True))
        langs, kinds = batch["lang"].to_pylist(), batch["kind"].to_pylist()
        f, asked = np.zeros(batch.num_rows, np.int64), np.array(kinds, bool)
        todo: dict[str, list[int]] = {}

        def answer() -> None:
            for lang, at in todo.items():
                if lang in held:
                    f[at] = held[lang].weights_of(_numbered(held[lang].words, [batch["part"][i].as_py().encode() for i in at]))
            todo.clear()

        for i, now in enumerate(places):
            if now != place:
                answer()
                place, held = now, {}
            if kinds[i]:
                todo.setdefault(langs[i], []).append(i)
            else:
                held[langs[i]] = Transducer.unpack(batch["packed"][i].as_py())
        answer()
        mine = pa.array(asked)
        yield pa.RecordBatch.from_arrays([*(batch[c].filter(mine) for c in ("lang", "part", "phrase", "k", "a", "cut", "second")), pa.array(f[asked])], names=["lang", "part", "phrase", "k", "a", "cut", "second", "f"])


PARTS = "lang string, part string, phrase string, k int, a long, cut int, second boolean, f long"


def part_counts(phrases: DataFrame, bucket_phrases: int = BUCKET_PHRASES, split_requests: int = SPLIT_REQUESTS) -> DataFrame:
    """For each candidate, cut and side: the part and its count, by composition with the phrases' transducers."""
    buckets = -(-max(1, phrases.count()) // bucket_phrases)
    bucket = F.pmod(F.xxhash64("lang", "part"), F.lit(buckets)).alias("bucket")
    own = phrases.withColumn("part", F.col("phrase")).select(bucket, "lang", "phrase", "f")
    packed = own.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_transducers, "bucket long, lang string, packed binary")
    words = F.split("phrase", " ", -1)
    sides = F.expr(f"flatten(transform(sequence(1, k - 1), i -> array(struct(i as cut, false as second, array_join(slice(w, 1, i), ' ') as part), struct(i as cut, true as second, array_join(slice(w, i + 1, {LONGEST}), ' ') as part))))")
    asked = phrases.where("k > 1").withColumn("w", words).select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(sides).alias("s")).select("lang", "phrase", "k", "a", "s.*").select("*", bucket)
    splits = asked.groupBy("bucket").agg(F.ceil(F.count("*") / split_requests).cast("int").alias("splits"))
    requests = asked.join(splits, "bucket").select("bucket", F.pmod(F.xxhash64("phrase"), F.col("splits")).cast("int").alias("split"), F.lit(1).alias("kind"), "lang", "part", "phrase", "k", "a", "cut", "second")
    copies = packed.join(splits, "bucket").select("bucket", F.explode(F.expr("sequence(0, splits - 1)")).alias("split"), F.lit(0).alias("kind"), "lang", "packed")
    both = requests.unionByName(copies, allowMissingColumns=True).repartition("bucket", "split").sortWithinPartitions("bucket", "split", "kind")
    return both.mapInArrow(_compose, PARTS)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, ranges: int | None = None, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS, bucket_phrases: int = BUCKET_PHRASES, split_requests: int = SPLIT_REQUESTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` candidates."""
    with small_batches(docs.sparkSession):
        words = materialize(word_counts(docs), "words")
        phrases = materialize(phrase_counts(docs, words, least, ranges, word_bits, pair_bits), "phrases")
        parts = materialize(part_counts(phrases, bucket_phrases, split_requests), "parts")
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    cuts = parts.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(~F.col("second"), F.col("f"))).alias("l"), F.max(F.when(F.col("second"), F.col("f"))).alias("r")).join(n, "lang")
    scored = cuts.withColumn("x", (wide["a"] * 1000 * wide["n"]).cast("decimal(38,0)")).withColumn("y", (wide["l"] * wide["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    # the first and second part at one word less, where it occurs no more often than the whole
    inside = F.when(F.col("second"), F.col("cut") == 1).otherwise(F.col("cut") == F.col("k") - 1)
    covered = parts.where((F.col("k") > 2) & inside & (F.col("f") == F.col("a"))).select("lang", F.col("part").alias("phrase")).distinct()
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(covered, ["lang", "phrase"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

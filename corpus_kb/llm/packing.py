"""Best-fit packing: a configuration linear program over the length histogram.

The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is all that the driver sees. Lengths are
grouped; multiplicative weights raise the price of groups that are still poorly covered, and a knapsack over the prices
finds the next configuration. The fractional solution is rounded down, its slots are filled with exact lengths, and what
remains, small pieces included, goes, longest first, to the fullest sequence that still has room.

The plan is a list of runs ("ranks a to b of length L go, p to a sequence, from sequence s on, at offset o"), so its size depends
on the number of lengths only. Ranks within a length come from two levels, per task and over tasks; no group of equal
lengths is gathered.

Rows: null and empty texts are the end id alone; repeated rows are packed once each; null ids are kept; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_kb.llm.common import binary_text, materialize

#: Parameters of the program: number of length groups, largest growth of a group's cover in one step, and the share of a
#: sequence above which a piece is large. Only large pieces enter the program; small ones fill the gaps of its configurations.
GROUPS, STEP, LARGE = 160, 0.2, 0.25
#: Ranks and lengths share one 64-bit key.
RANK_BITS = 44


class WordIds:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its words in order. Each distinct
    word is encoded once; the table is emptied when it holds ``limit`` words. A word of Latin letters, with or without marks
    behind it, goes straight to the tokenizer's merge model; any other word goes through the whole tokenizer.
    """

    #: Letters that lower-casing and composition leave as they are, and ASCII marks that never join a letter's piece.
    LATIN, MARKS = re.compile("[a-zß-öø-ÿ]+"), ".,!?;:$%&*#|"

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(0xDF, 0x100)]
        # the byte-level alphabet writes bytes from 0xA1 on (but 0xAD) as themselves, those below as 0x100 + their place among the rest
        rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        shown = {b: chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256)}
        self.bytes_shown = {ord(c): "".join(shown[b] for b in c.encode()) for c in letters}

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode().lower()
        core = text.rstrip(self.MARKS)
        if not self.LATIN.fullmatch(core):
            return self.whole(word.decode())
        ids = array("I", [t.id for t in self.model.tokenize(core.translate(self.bytes_shown))]).tobytes()
        if len(core) == len(text):
            return ids
        marks = text[len(core) :].encode()
        if marks not in self.known:
            self.known[marks] = self.whole(text[len(core) :])
        return ids + self.known[marks]

    def packed(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words, known = text.split(), self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
        return b"".join([known[w] for w in words])


_CODERS: dict[str, WordIds] = {}


def coder_of(path: str) -> WordIds:
    """One coder a worker process: its words outlive the task."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


@dataclass
class Plan:
    """Runs of pieces; arrays of equal length, sorted by ``start`` = length << RANK_BITS | first rank."""

    start: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    per: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.start, (length << RANK_BITS) + rank, "right") - 1
        nth = rank - (self.start[at] & ((1 << RANK_BITS) - 1))
        return self.base[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def knapsack(value: np.ndarray, weight: list[int], most: list[int], capacity: int) -> list[int]:
    """Copies of each item, at most ``most``, that maximise the value within the capacity (binary bundles of copies)."""
    best, bundles = np.zeros(capacity + 1), []
    for i, (v, w, m) in enumerate(zip(value.tolist(), weight, most, strict=True)):
        m, k = min(m, capacity // w), 1
        while m > 0:
            k = min(k, m)
            cost = k * w
            taken = best[: capacity + 1 - cost] + k * v
            better = taken > best[cost:]
            best[cost:][better] = taken[better]
            bundles.append((i, k, cost, better))
            m, k = m - k, 2 * k
    copies, room = [0] * len(weight), capacity
    for i, k, cost, better in reversed(bundles):
        if room >= cost and better[room - cost]:
            copies[i] += k
            room -= cost
    return copies


def configurations(weight: list[int], demand: list[int], capacity: int, step: float = STEP) -> list[tuple[tuple[int, ...], float]]:
    """Fractional configurations that cover every demand: multiplicative weights with knapsack pricing."""
    need, cover = np.array(demand, float), np.zeros(len(demand))
    used: dict[tuple[int, ...], float] = {}
    sharp = np.log(len(demand) + 1) * 4
    while cover.min(initial=1.0) < 1.0:
        price = np.exp(-sharp * (cover - cover.min())) / need
        found = tuple(knapsack(price, weight, demand, capacity))
        share = np.array(found) / need
        by = step / share.max()
        used[found] = used.get(found, 0.0) + by
        cover += by * share
    scale = cover.min(initial=1.0)
    return sorted(((c, x / scale) for c, x in used.items()), key=lambda p: (-p[1], p[0]))


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[np.ndarray]:
    """Runs of neighbouring lengths that hold about the same number of tokens each; longest first."""
    order = np.argsort(-lengths)
    mass = np.cumsum((lengths * counts)[order].astype(float))
    name = np.minimum((mass - 1e-9) * groups / mass[-1], groups - 1).astype(int)
    return [order[name == g] for g in np.unique(name)]


@dataclass
class _Bins:
    """Open sequences by the room they have left, and the runs placed so far."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    rooms: list[int] = field(default_factory=list)
    stock: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    sequences: int = 0

    def new(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def keep(self, room: int, base: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in self.stock:
                insort(self.rooms, room)
                self.stock[room] = []
            self.stock[room].append((base, n))

    def put(self, length: int, rank: int, base: int, n: int, per: int, room: int) -> int:
        """``per`` pieces in each of ``n`` sequences that have ``room`` left."""
        self.runs.append((length, rank, base, self.capacity - room, per, n))
        return room - per * length


def plan_packing(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int = GROUPS, step: float = STEP, large: float = LARGE) -> Plan:
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    used = dict.fromkeys(left, 0)
    bins = _Bins(capacity)

    def take(length: int, n: int) -> int:
        rank, used[length], left[length] = used[length], used[length] + n, left[length] - n
        return rank

    if left.get(capacity):
        n = left[capacity]
        bins.put(capacity, take(capacity, n), bins.new(n), n, 1, capacity)
    part = (lengths < capacity) & (lengths > large * capacity)
    if part.any():
        members = [lengths[part][g].tolist() for g in grouped(lengths[part], counts[part], groups)]
        demand = [sum(left[x] for x in g) for g in members]
        every = [x for g in members for x in g]
        for found, amount in configurations([max(g) for g in members], demand, capacity, step):
            slots = [(g, a) for g, a in enumerate(found) if a]
            n = min([int(amount), *(sum(left[x] for x in members[g]) // a for g, a in slots)])
            if n <= 0:
                continue
            slots[-1:] = [(g, a) for g, a in ((slots[-1][0], slots[-1][1] - 1), (None, 1)) if a]
            open_now = [(capacity, bins.new(n), n)]
            for g, a in slots:
                filled, todo = [], [(*x, a) for x in open_now]
                while todo:
                    room, base, n, need = todo.pop()
                    # the last slot takes the longest large piece that fits, whatever its group
                    length = next((x for x in (every if g is None else members[g]) if left[x] and x <= room), None)
                    if length is None:
                        filled.append((room, base, n))
                        continue
                    per = min(need, left[length])
                    k = min(n, left[length] // per)
                    rest = bins.put(length, take(length, k * per), base, k, per, room)
                    (todo if per < need else filled).append((rest, base, k, need - per) if per < need else (rest, base, k))
                    if k < n:
                        todo.append((room, base + k, n - k, need))
                open_now = filled
            for room, base, n in open_now:
                bins.keep(room, base, n)
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(bins.rooms, length)
            if at < len(bins.rooms):
                room = bins.rooms[at]
                base, n = bins.stock[room].pop()
                if not bins.stock[room]:
                    del bins.stock[room], bins.rooms[at]
                per = min(room // length, left[length])
                k = min(n, left[length] // per)
                bins.keep(room, base + k, n - k)
            else:
                per = min(capacity // length, left[length])
                k, room = left[length] // per, capacity
                base = bins.new(k)
            bins.keep(bins.put(length, take(length, k * per), base, k, per, room), base, k)
    runs = np.array(sorted(bins.runs), np.int64).reshape(-1, 6)
    return Plan((runs[:, 0] << RANK_BITS) + runs[:, 1], runs[:, 2], runs[:, 3], runs[:, 4], bins.sequences)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids with their rank among the task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, task = coder_of(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.packed(text.as_py()) + end
                for piece, first in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[first : first + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, first // 4, n, zlib.crc32(cut), task, int(seen[n]), cut if keep_ids else None))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary")
    return out if keep_ids else out.drop("ids")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each is given."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece_counts")
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toPandas()
    plan = spark.sparkContext.broadcast(plan_packing(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"), *(["ids"] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            at = batch.schema.get_field_index("rank")
            yield batch.remove_column(at).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")

"""Cheapest repair of conversation structure by a run-length dynamic program.

Rows of a conversation become symbols: the initial of the role and the fault. An automaton of four states reads role initials
(``START``, after s, after u, after a) and accepts ``(s?(ua)+)?``. A symbol's *transition* is a 4 x 4 min-plus matrix: the least cost of getting from state
to state over one row by any inserts and then a keep, a rerole or a delete. Equal consecutive symbols are one run, whose matrix comes
from the cached binary powers of its symbol's transition. Matrices multiply, so a conversation of any length is cut into *blocks* of bounded size:

1. rows are range-partitioned by conversation, turn and digest, and every task cuts its sorted rows into blocks with a matrix each;
2. narrow: from a conversation's last block to its first, the cost to go at the end of each block (four numbers);
3. in parallel: each block unrolls its choices from every state that it may start in, the ASCII-least among the cheapest;
4. from first block to last: the state picks the piece of the audit, and the repaired lines run through the digest.

A digest reads its conversation in order, so step 4 streams a conversation in one task, a block in memory at a time; all else is
split whatever share of the rows one conversation has. The first use of a role and text is a minimum by digest, combined before the exchange.

Rows: a null role or text is one space, and so are nulls in the key of the damage; rows with a null conv_id are one conversation; null turns come
first; rows of one turn are ordered by the SHA-256 of role and text, equal ones are adjacent; an empty role has no initial, so it is never kept in place; a conversation
without rows after damage has zeros, an empty audit and the digest of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_kb.llm.common import materialize, small_batches

#: Costs of the edits; keep is free.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, NEVER = 4, 1 << 60
#: Role classes of a symbol; ``GONE`` is the symbol of rows that have to be deleted.
ROLES, GONE = "sua", 8
#: Rows and characters of text from which a block is full.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)


def kept(state: int, role: int) -> int | None:
    """State after a row of this role class, None where it may not stand."""
    if role == 0:
        return AFTER_S if state == START else None
    return _NEXT[state] if role < 3 and (_NEXT[state] == AFTER_U) == (role == 1) else None


def choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after it) of the edits of a row."""
    yield "D", DELETE, state
    if symbol != GONE:
        role, extra = symbol >> 1, TRUNCATED * (symbol & 1)
        if (after := kept(state, role)) is not None:
            yield "K", extra, after
        yield "R", REROLE + extra, _NEXT[state]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


@cache
def closure() -> np.ndarray:
    """Least cost from state to state by inserts alone."""
    out = np.full((STATES, STATES), NEVER)
    for state in range(STATES):
        at, cost = state, 0
        while out[state, at] > cost:
            out[state, at] = cost
            at, cost = _NEXT[at], cost + INSERT
    return out


@cache
def power(symbol: int, exponent: int) -> np.ndarray:
    """Transition over ``2**exponent`` rows of one symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    row = np.full((STATES, STATES), NEVER)
    for state in range(STATES):
        for _, cost, after in choices(symbol, state):
            row[state, after] = min(row[state, after], cost)
    return times(closure(), row)


def exponents(n: int) -> list[int]:
    return [e for e in range(n.bit_length()) if n >> e & 1]


def runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def matrix(symbols: bytes) -> np.ndarray:
    """Transition over all rows of a block."""
    out = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
    for symbol, n in runs(symbols):
        for e in exponents(n):
            out = times(out, power(symbol, e))
    return out


def before(transition: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost to go ahead of a transition, from the cost to go behind it."""
    return np.minimum((transition + after[None, :]).min(1), NEVER)


def last_costs() -> np.ndarray:
    """Cost to go behind the last row: inserts up to an accepting state."""
    return closure()[:, [START, AFTER_A]].min(1)


def unroll(symbols: bytes, behind: np.ndarray, start: int) -> tuple[str, int]:
    """ASCII-least letters of a cheapest way through a block from a state, and the state it ends in."""
    parts = runs(symbols)
    ends = [behind]
    for symbol, n in reversed(parts):
        ahead = ends[-1]
        for e in exponents(n):
            ahead = before(power(symbol, e), ahead)
        ends.append(ahead)
    letters, state = [], start
    for (symbol, n), end in zip(parts, ends[-2::-1], strict=True):
        step, to_go = power(symbol, 0), [end]
        for _ in range(n):
            to_go.append(before(step, to_go[-1]))
        to_go = [x.tolist() for x in reversed(to_go)]
        for row in range(n):
            while True:
                here, behind_row = to_go[row], to_go[row + 1]
                options = sorted([*((c, cost + behind_row[after], after) for c, cost, after in choices(symbol, state)), ("I", INSERT + here[_NEXT[state]], _NEXT[state])])
                letter, _, state = next(o for o in options if o[1] == here[state])
                letters.append(letter)
                if letter != "I":
                    break
    return "".join(letters), state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by ``crc32(conv_id:turn) % 20``; dropped rows stay, with ``dropped`` set."""
    conv, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    name = F.concat(*(F.coalesce(c.cast("string"), F.lit(" ")) if c is not None else F.lit(":") for c in (conv, None, turn)))
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _turn_order() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``digest`` of role and text and ``fault``: 1 blank, 2 duplicate of an earlier turn, 3 truncated, 0 none.

    Of equal rows in one turn the first is told from the others where rows are cut into blocks.
    """
    held = F.rtrim("text", F.lit(SPACE))
    marked = rows.withColumn("digest", F.sha2(F.concat(F.sha2("role", 256), F.col("text")), 256)).withColumn(
        "bare", F.when(held == "", 1).when(~F.right(held, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))
    told = marked.where(~F.col("dropped")).groupBy("conv_id", "digest").agg(F.min(_turn_order()).alias("first"), F.count("*").alias("n")).where("n > 1")
    a, b = marked.alias("a"), told.alias("b")
    met = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    later = F.coalesce(_turn_order() > F.col("first"), F.lit(False))
    return met.select("a.*", F.when((F.col("bare") == 1) | ~later, F.col("bare")).otherwise(2).alias("fault")).drop("bare")


BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("seq", pa.int64()), ("maybe_later", pa.bool_()), ("symbols", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("turns", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64()))])
BLOCK_DDL = ("conv_id long, seq long, maybe_later boolean, symbols binary, roles array<string>, texts array<string>, turns array<long>, counts array<long>, "
             "ends array<string>, matrix array<long>")


class _Block:
    """Rows of one conversation on their way into a block."""

    def __init__(self, conv: int | None, later: bool) -> None:
        self.conv, self.later, self.empty = conv, later, True
        self.before: tuple | None = None
        self.clear()

    def clear(self) -> None:
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.turns: list[int] = []  # first, last, how many different ones
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal within

    def add(self, turn: int | None, role: str, text: str, digest: str, fault: int) -> None:
        if fault != 1 and (turn, digest) == self.before:
            fault = 2
        self.before = (turn, digest)
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.counts[3] += 1
        if fault:
            self.counts[fault - 1] += 1
        known = ROLES.find(role[:1]) if role else -1
        self.symbols.append(GONE if fault in (1, 2) else 2 * (known if known >= 0 else 3) + (fault == 3))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]

    def row(self, seq: int) -> dict:
        out = {
            "conv_id": self.conv, "seq": seq, "maybe_later": self.later, "symbols": bytes(self.symbols), "roles": self.roles, "texts": self.texts, "turns": self.turns,
            "counts": self.counts, "ends": [self.roles[0][:1], self.roles[-1][:1]] if self.roles else [], "matrix": matrix(self.symbols).ravel().tolist()}
        self.later, self.empty = True, False
        self.clear()
        return out


#: Initials that may follow each other.
LEGAL = {"su", "ua", "au"}


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted rows; only the first conversation of a task may have begun in an earlier one."""
    base, n, block, out = TaskContext.get().partitionId() << 36, 0, None, []

    def close() -> None:
        nonlocal n
        if block is not None and (block.roles or block.empty):
            out.append(block.row(base + n))
            n += 1

    for batch in batches:
        for conv, turn, role, text, digest, fault, dropped in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "fault", "dropped")), strict=True):
            if block is None or conv != block.conv:
                close()
                block = _Block(conv, block is None)
            if not dropped:
                block.add(turn, role, text, digest, fault)
                if len(block.roles) >= most or block.chars >= BLOCK_CHARS:
                    close()
        yield pa.RecordBatch.from_pylist(out, BLOCK)
        out = []
    close()
    yield pa.RecordBatch.from_pylist(out, BLOCK)


def blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    order = ("conv_id", "turn", "digest")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_cut, most=most), BLOCK_DDL)


def _to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, cost to go at the block's end) of blocks that come from last to first."""
    conv, ahead, any_row = None, last_costs(), False
    for batch in batches:
        out = []
        for c, seq, m in zip(batch["conv_id"].to_pylist(), batch["seq"].to_pylist(), batch["matrix"].to_pylist(), strict=True):
            if c != conv or not any_row:
                conv, ahead, any_row = c, last_costs(), True
            out.append((seq, ahead.tolist()))
            ahead = before(np.array(m).reshape(STATES, STATES), ahead)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int64()))], names=["seq", "behind"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit piece and end state of each block from every state that it may start in."""
    for batch in batches:
        audits, states = [], []
        for symbols, later, behind in zip(batch["symbols"].to_pylist(), batch["maybe_later"].to_pylist(), batch["behind"].to_pylist(), strict=True):
            found = [unroll(symbols, np.array(behind), q) for q in (range(STATES) if later else [START])]
            audits.append([a for a, _ in found])
            states.append([q for _, q in found])
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["seq"], pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], names=["conv_id", "seq", "audits", "states"])


RESULT = pa.schema([(name, pa.int64()) for name in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """Running result of one conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.state, self.audit, self.cost = conv, START, [], 0
        self.counts, self.turns, self.last_initial = [0, 0, 0, 0], None, None
        self.digest, self.lines = hashlib.sha256(), 0

    def say(self, lines: list[str]) -> None:
        if lines:
            self.digest.update((("\n" if self.lines else "") + "\n".join(lines)).encode())
            self.lines += len(lines)

    def edit(self, letters: str, symbols: bytes, roles: list[str], texts: list[str]) -> None:
        at, lines = 0, []
        for letter in letters:
            if letter == "D":
                self.cost += DELETE
            elif letter == "K":
                self.state = kept(self.state, symbols[at] >> 1)
                lines.append(f"{roles[at]}:{texts[at]}")
            else:
                self.state = _NEXT[self.state]
                lines.append(("user:" if self.state == AFTER_U else "assistant:") + (texts[at] if letter == "R" else ""))
                self.cost += REROLE if letter == "R" else INSERT
            if letter != "I":
                self.cost += TRUNCATED * (letter != "D" and symbols[at] & 1)
                at += 1
        self.audit.append(letters)
        self.say(lines)

    def add(self, block: dict, audits: list[str], states: list[int]) -> None:
        for i, c in enumerate(block["counts"]):
            self.counts[i] += c
        if block["ends"]:
            if self.last_initial is not None and self.last_initial + block["ends"][0] not in LEGAL:
                self.counts[3] += 1
            self.last_initial = block["ends"][1]
        if block["turns"]:
            first, last, n = block["turns"]
            if self.turns is None:
                self.turns = [first, last, n]
            else:
                self.turns = [self.turns[0], last, self.turns[2] + n - (first == self.turns[1])]
        end = states[self.state]
        self.edit(audits[self.state], block["symbols"], block["roles"], block["texts"])
        assert end == self.state

    def result(self) -> dict:
        self.edit("I" * {START: 0, AFTER_A: 0, AFTER_U: 1, AFTER_S: 2}[self.state], b"", [], [])
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return dict(zip(RESULT.names, (self.conv, gaps, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest()), strict=True))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and block, each block's audit pieces just ahead of its rows."""
    now, pieces = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                pieces = row["audits"], row["states"]
                continue
            if now is None or now.conv != row["conv_id"]:
                if now is not None:
                    out.append(now.result())
                now = _Repair(row["conv_id"])
            now.add(row, *pieces)
        yield pa.RecordBatch.from_pylist(out, RESULT)
    yield pa.RecordBatch.from_pylist([now.result()] if now is not None else [], RESULT)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cheapest edits and the repaired digest of every conversation of rows (conv_id, turn, role, text, dropped)."""
    spark = rows.sparkSession
    with small_batches(spark, 1000):
        cut = materialize(blocks(faults(rows), block_rows), "blocks")
        narrow = cut.select("conv_id", "seq", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
        to_go = narrow.mapInArrow(_to_go, "seq long, behind array<long>")
        found = cut.select("conv_id", "seq", "symbols", "maybe_later").join(to_go.hint("merge"), "seq")
        pieces = materialize(found.mapInArrow(_pieces, "conv_id long, seq long, audits array<string>, states array<int>"), "pieces")
    said = cut.select("conv_id", "seq", F.lit(1).alias("kind"), "symbols", "roles", "texts", "turns", "counts", "ends")
    both = said.unionByName(pieces.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind").mapInArrow(_finish, RESULT_DDL)


def damage_and_repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return repair(damaged(conversations), block_rows)

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from corpus_kb.llm import repair
from corpus_kb.llm.common import table

SHAPE = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by a plain dynamic program over suffixes."""

    def may(said, initial):
        return initial == "s" and said == "" or initial == "u" and said in ("", "s", "a") or initial == "a" and said == "u"

    @cache
    def with_inserts(i, said, left):
        options = []
        if i == len(rows) and said in ("", "a"):
            options.append((0, "", ()))
        if left:
            for new in ("user", "assistant"):
                if may(said, new[0]):
                    cost, audit, lines = with_inserts(i, new[0], left - 1)
                    options.append((cost + 5, "I" + audit, (new + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = with_inserts(i + 1, said, left)
            options.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if new and may(said, new[0]):
                        cost, audit, lines = with_inserts(i + 1, new[0], left)
                        options.append((cost + price + extra, letter + audit, (f"{new}:{text}", *lines)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return with_inserts(0, "", min(len(rows) + 2, 6))


def brute(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text) before damage."""
    out, after = {}, plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256((hashlib.sha256(r[2].encode()).hexdigest() + r[3]).encode()).hexdigest()))
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faulty.append((role, text, fault))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, lines = cheapest(tuple(faulty))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, parts=3, block_rows=repair.BLOCK_ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).repartition(parts)
    return {r[0]: tuple(r)[1:] for r in repair.damage_and_repair(df, block_rows).collect()}


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "unknown", None])
            text = rng.choice(["Yes.", "no", "why? ", "ok!\n", "", " \t", None, "é!", "ends 。"]) if rng.random() < 0.5 else f"w{rng.randrange(99)}" + rng.choice([".", "!", ""])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_plain_program(spark, seed):
    rows = conversations(seed, 60, 9) + [(None, 1, "user", "x."), (None, None, "assistant", None)]
    assert run(spark, rows) == brute(rows)


def test_small_blocks(spark):
    """A block every two rows: states and costs pass from block to block."""
    rows = conversations(5, 25, 30)
    for symbols in [bytes(random.Random(i).choices(range(9), k=12)) for i in range(40)]:
        whole = repair.matrix(symbols)
        assert (repair.times(repair.matrix(symbols[:5]), repair.matrix(symbols[5:])) == whole).all()
        letters, end = repair.unroll(symbols, repair.last_costs(), 0)
        behind = repair.before(repair.matrix(symbols[5:]), repair.last_costs())
        one, middle = repair.unroll(symbols[:5], behind, 0)
        two, last = repair.unroll(symbols[5:], repair.last_costs(), middle)
        assert (one + two, last) == (letters, end)
    assert run(spark, rows, block_rows=2) == brute(rows)


def test_one_long_conversation_over_all_tasks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"t{t % 4001}.") for t in range(9000)] + conversations(6, 10, 6)
    got = run(spark, rows, 8)
    after = [r for r in plain_damage(rows) if r[0] == 7]
    assert len(got[7][6].replace("I", "")) == len(after)
    # the cost by one pass of the program over all rows
    seen, symbols = set(), bytearray()
    for _, _, role, text in sorted(after, key=lambda r: r[1]):
        gone = not text.strip() or (role, text) in seen
        seen.add((role, text))
        symbols.append(8 if gone else 2 * "sua".index(role[0]) + (text[-1] not in ".!?"))
    assert got[7][5] == int(repair.before(repair.matrix(bytes(symbols)), repair.last_costs())[0])
    assert (repair.unroll(bytes(symbols), repair.last_costs(), 0)[0] + "I" * 2)[: len(got[7][6])] == got[7][6]


def test_powers_equal_repeated_steps():
    for symbol, n in product(range(9), (1, 2, 3, 7, 20)):
        step = repair.power(symbol, 0)
        want = step
        for _ in range(n - 1):
            want = repair.times(want, step)
        assert (repair.matrix(bytes([symbol]) * n) == want).all()


def test_audits_give_the_shape():
    for symbols in product(range(9), repeat=4):
        letters, state = repair.unroll(bytes(symbols), repair.last_costs(), 0)
        said, now = "", 0
        at = 0
        for c in letters + "I" * {0: 0, 3: 0, 2: 1, 1: 2}[state]:
            if c in "IR":
                now = repair._NEXT[now]
                said += "?sua"[now]
            elif c == "K":
                said += "sua"[symbols[at] >> 1]
                now = repair.kept(now, symbols[at] >> 1)
            at += c != "I"
        assert SHAPE.fullmatch(said), (symbols, letters, said)


def test_whole_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in docs.collect()]
    assert {r[0]: tuple(r)[1:] for r in repair.damage_and_repair(docs).collect()} == brute(rows)


def test_edges(spark):
    assert run(spark, [(1, 0, "user", "x")])[1][-1]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.damage_and_repair(empty).count() == 0
    rows = [(2, 1, "user", "a." * 400_000), (2, 1, "user", "a." * 400_000), (2, 2, None, None), (None, None, None, None), (3, 5, "assistant", "")]
    assert run(spark, rows) == brute(rows)

"""SimHash components by Golay-code fuzzy hashing.

The perfect Golay code [23, 12, 7] puts every 23-bit word within three bits of exactly one codeword. The *keys* of a word are the
codewords that the word and its 23 neighbours at one bit decode to: one key where the word lies within two bits of its codeword, six otherwise.
Two words that differ in at most two bits have a common neighbour, so they share a key.

A fingerprint has two 23-bit segments a, b and a third of 18 bits, c. By pigeonhole over at most two differing bits one of these holds:

* no error in a: both have the same a and share a key of b (at most two errors);
* no error in b: both have the same b and share a key of a;
* one error in a, one in b, none in c: both have the same c. Words at one bit have different parities, so the even one
  gives the codeword it decodes to alone, the odd one all its keys; the same for b.

Equal fingerprints are collapsed first. Buckets of equal entries are verified exactly: up to ``BUCKET`` different fingerprints by
comparing the bucket's members, which yields a spanning forest of the bucket's links. The members of larger buckets meet by midpoints
instead: each gives itself and its 64 neighbours, and all fingerprints of one midpoint differ in at most two bits from each
other. That costs 65 entries a fingerprint whatever the bucket's size, so no group is expanded into its pairs and no link is lost.

Rows: null, empty and blank texts have the fingerprint zero and are linked like any other; a text with fewer words than a shingle is one shingle;
rows that repeat an id are reported each and share the links of their texts; rows with a null id get a fingerprint, are linked with nothing and have a
null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_kb.llm.common import arrow_map, binary_text, materialize, small_batches, whole_words
from corpus_kb.llm.jaccard import components

WORDS, SEED = 3, 42
#: Different fingerprints of a bucket up to which its members are compared with each other.
BUCKET = 256
SEGMENT, LAST = (1 << 23) - 1, (1 << 18) - 1
#: Generator of the Golay code as a polynomial over GF(2), x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 where over half of the shingles' XXH64 hashes have it, repeated shingles included; 0 without words."""
    found = whole_words(text)
    if not found:
        return 0
    joined, k = b" ".join(found), min(words, len(found))
    ends = list(accumulate(len(w) + 1 for w in found))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(found) - k + 1
    starts = [0, *ends]
    for at in range(0, n, 50_000):
        stop = min(n, at + 50_000)
        hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts[at:stop], ends[at + k - 1 : stop + k - 1], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, the 64 bits as a signed long."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text())
    return arrow_map(narrow, "doc_id long, fp long", lambda b: {
        "doc_id": b["doc_id"], "fp": np.array([fingerprint(t.as_py(), words, seed) for t in b["text"]], np.uint64).view(np.int64)})


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of each byte at each of three places; per syndrome the errors of at most four bits, the least first, and how many."""
    remainder = [0] * 23
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        remainder[i] = r
    of_byte = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * place + bit < 23:
                    of_byte[place, value] ^= remainder[8 * place + bit]
    errors, n = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= remainder[b]
            if weight < 4 or n[s] and errors[s, 0].bit_count() == 3:
                errors[s, n[s]] = sum(1 << b for b in bits)
                n[s] += 1
    return of_byte, errors, n


def codeword_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords of up to six keys of each 23-bit word, the decoded one first, and how many are valid."""
    of_byte, errors, n = _code()
    s = of_byte[0, x & 255] ^ of_byte[1, x >> 8 & 255] ^ of_byte[2, x >> 16 & 255]
    # the code is cyclic and systematic: the upper 12 bits name the codeword
    return (x[:, None] ^ errors[s]) >> 11, n[s]


def entries(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries and the position of the fingerprint that each belongs to."""
    bits = fp.view(np.uint64)
    a, b, c = ((bits >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, SEGMENT), (23, SEGMENT), (46, LAST)))
    (ka, na), (kb, nb), at = codeword_keys(a), codeword_keys(b), np.arange(len(fp))
    valid_a, valid_b = np.arange(6) < na[:, None], np.arange(6) < nb[:, None]
    some_a = np.arange(6) < np.where(np.bitwise_count(a) & 1, na, 1)[:, None]
    some_b = np.arange(6) < np.where(np.bitwise_count(b) & 1, nb, 1)[:, None]
    both = some_a[:, :, None] & some_b[:, None, :]
    pair = (2 << 60) | c[:, None, None] << 24 | ka[:, :, None] << 12 | kb[:, None, :]
    keys = [((a << 12)[:, None] | kb)[valid_b], ((1 << 60) | (b << 12)[:, None] | ka)[valid_a], pair[both]]
    of = [np.repeat(at, valid_b.sum(1)), np.repeat(at, valid_a.sum(1)), np.repeat(at, both.sum((1, 2)))]
    return np.concatenate(keys), np.concatenate(of)


def forest(fp: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most ``most`` bits connect among a few fingerprints."""
    near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= most
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; rows come sorted by key, a run has at most ``BUCKET`` rows."""
    held = None
    for batch in batches:
        rows = np.stack([batch["key"].to_numpy(), batch["fp"].to_numpy()], 1)
        held = rows if held is None else np.concatenate([held, rows])
        cuts = np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1
        if len(cuts):
            yield _links(held[: cuts[-1]], cuts)
            held = held[cuts[-1] :]
    if held is not None and len(held):
        yield _links(held, np.array([len(held)]))


def _links(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.concatenate([[0], cuts[:-1]])
    two = cuts - starts == 2
    left, right = rows[starts[two], 1], rows[starts[two] + 1, 1]
    near = np.bitwise_count((left ^ right).view(np.uint64)) <= 2
    found.append((np.maximum(left, right)[near], np.minimum(left, right)[near]))
    found += [forest(rows[s:e, 1]) for s, e in zip(starts[~two].tolist(), cuts[~two].tolist(), strict=True) if e - s > 1]
    pairs = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints (column ``fp``) that connect just what the links connect."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for start in range(0, len(fp), 20_000):
                part = fp[start : start + 20_000]
                keys, of = entries(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[of])], names=["key", "fp"])

    keyed_rows = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    sizes = keyed_rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # merge join: the many rows of a hot key are split, its sizes are one row
    shared = materialize(keyed_rows.join(sizes.hint("merge"), "key"), "buckets")
    small = shared.where(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key")
    large = shared.where(F.col("n") > bucket).select("fp").distinct()
    around = large.select("fp", F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b")
    return small.mapInArrow(_compare, "a long, b long").unionByName(stars).distinct()


def join(docs: DataFrame, words: int = WORDS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row; at most two bits apart are linked."""
    with small_batches(docs.sparkSession):
        rows = materialize(fingerprints(docs, words, seed), "fingerprints")
    firsts = materialize(rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    labels = components(links(firsts, bucket)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = firsts.join(labels, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return rows.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))

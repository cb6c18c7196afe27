"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Sizes come first: with N rows and S shards every shard gets floor(N/S) or one more, and each shard is cut into buckets of at most
``bucket_rows`` rows, so a task holds one bucket and never one shard. How many rows of input part p go to bucket b is the
communication matrix of a uniform permutation: its rows are multivariate hypergeometric. A part finds its own row alone, going
down a binary tree over the parts; each node of the tree splits its column totals between its halves with a generator seeded
by the node, so no matrix is ever stored or sent. Rows are then permuted within the part, exchanged by bucket, and
permuted again within the bucket.

Rows: null texts have size 1 and crc32 0; repeated rows and null ids are dealt like any other; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import floor, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_kb.llm.common import binary_text, materialize, rng_of

#: numpy draws hypergeometric numbers from populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good items among ``drawn``; populations beyond numpy's limit by ratio of uniforms (Stadlober 1989)."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    total, n = good + bad, min(drawn, good + bad - drawn)
    few, many = min(good, bad), max(good, bad)
    if n == 0:
        return good
    share = few / total
    mean, spread = n * share + 0.5, sqrt((total - n) * n * share * (1 - share) / (total - 1) + 0.5)
    width, top = 1.7155277699214135 * spread + 0.8989161620588988, min(min(n, few) + 1, floor(n * share + 0.5 + 16 * spread))
    mode = (n + 1) * (few + 1) // (total + 2)

    def weight(k: int) -> float:
        return lgamma(k + 1) + lgamma(few - k + 1) + lgamma(n - k + 1) + lgamma(many - n + k + 1)

    peak = weight(mode)
    while True:
        u, v = rng.random(), rng.random()
        x = mean + width * (v - 0.5) / u if u > 0 else -1.0
        if 0 <= x < top and n - many <= floor(x) and 2 * log(u) <= peak - weight(floor(x)):
            k = floor(x)
            break
    k = k if good <= bad else n - k
    return k if drawn == n else good - k


def split_columns(rng: np.random.Generator, columns: np.ndarray, drawn: int) -> np.ndarray:
    """Multivariate hypergeometric draw of ``drawn`` items from columns of these sizes."""
    total = int(columns.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(columns, drawn, method="marginals")
    out, rest = np.zeros_like(columns), drawn
    for i, size in enumerate(columns.tolist()):
        total -= size
        out[i] = hypergeometric(rng, size, total, rest)
        rest -= int(out[i])
    return out


def matrix_row(part: int, rows: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix with these row sums and column sums."""
    before = np.concatenate([[0], np.cumsum(rows)])
    low, high, mine = 0, len(rows), columns
    while high - low > 1:
        middle = (low + high) // 2
        left = split_columns(rng_of(seed, low, high, 1), mine, int(before[middle] - before[low]))
        low, high, mine = (low, middle, left) if part < middle else (middle, high, mine - left)
    return mine


def bucket_sizes(total: int, shards: int, bucket_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all buckets and the shard of each: shards at most one row apart, and so are the buckets of a shard."""
    sizes, of = [], []
    for shard in range(shards):
        size = total // shards + (shard < total % shards)
        parts = max(1, -(-size // bucket_rows))
        sizes += [size // parts + (i < size % parts) for i in range(parts)]
        of += [shard] * parts
    return np.array(sizes, np.int64), np.array(of, np.int64)


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_rows: int = 100_000) -> DataFrame:
    """Law ``rows``: shard and slot of every row after a uniform shuffle; ``grown_shard`` belongs to another law and is null."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                 pa.array([part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64())], names=["doc_id", "size", "text_crc32", "part", "nth"])
            nth += n

    spark = docs.sparkSession
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).mapInArrow(
        measure, "doc_id long, size long, text_crc32 long, part int, nth long"), "measured")
    found = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    parts = max(found, default=-1) + 1
    sums = np.array([found.get(p, 0) for p in range(parts)], np.int64)
    columns, shard_of = bucket_sizes(int(sums.sum()), shards, bucket_rows)
    first_of_shard = np.array([np.searchsorted(shard_of, s) for s in shard_of])
    before = np.concatenate([[0], np.cumsum(columns)])
    slot_of = before[:-1] - before[first_of_shard]
    plan = spark.sparkContext.broadcast((sums, columns, shard_of, slot_of))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, columns, _, _ = plan.value

        @lru_cache(maxsize=2)
        def of_part(part: int) -> tuple[np.ndarray, np.ndarray]:
            return rng_of(seed, part, 2).permutation(int(sums[part])), np.cumsum(matrix_row(part, sums, columns, seed))

        for batch in batches:
            part, nth = batch.column("part").to_numpy(), batch.column("nth").to_numpy()
            bucket = np.empty(len(part), np.int64)
            for p in np.unique(part):
                places, ends = of_part(int(p))
                bucket[part == p] = np.searchsorted(ends, places[nth[part == p]], "right")
            yield batch.append_column("bucket", pa.array(bucket))

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, shard_of, slot_of = plan.value
        bucket = key[0].as_py()
        rows = rows.sort_by([("part", "ascending"), ("nth", "ascending")])
        n = rows.num_rows
        slot = rng_of(seed, bucket, 3).permutation(n) + slot_of[bucket]
        return pa.table({
            "doc_id": rows["doc_id"], "size": rows["size"], "text_crc32": rows["text_crc32"], "law": pa.array(["rows"] * n, pa.string()),
            "shard": pa.array([int(shard_of[bucket])] * n, pa.int32()), "slot": pa.array(slot, pa.int64()), "grown_shard": pa.nulls(n, pa.int32())})

    dealt = rows.mapInArrow(deal, "doc_id long, size long, text_crc32 long, part int, nth long, bucket long")
    return dealt.groupBy("bucket").applyInArrow(settle, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")

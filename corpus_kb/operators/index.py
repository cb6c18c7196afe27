"""Inverted index over chunk or entity texts.

Postings are counted within batches of items (sorted code points, run lengths), so building them needs
no shuffle. The written index is range-partitioned on (bucket, gram, id): a gram that occurs in most
items is spread over many tasks and files instead of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_kb.functions.text import runs

GRAM = 3
#: Items whose grams are sorted together.
SLICE_ROWS = 500
# two closing characters give every position of a text a window, so 1- and 2-character terms are
# prefixes of indexed grams
PAD = "\x00\x00"


def _counted(items: DataFrame, id_col: str, tokens: Column, name: str) -> DataFrame:
    return items.select(F.col(id_col), F.inline(runs(F.sort_array(tokens)))).select(
        F.col("item").alias(name), id_col, F.col("n").cast("bigint").alias("tf")
    )


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``row, gram`` of every window of ``GRAM`` characters; a gram is its code points in 21 bits each."""
    data = texts.cast(pa.large_string())
    joined = "\n".join(data.to_pylist()) if len(data) else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    count = np.maximum(sizes - (GRAM - 1), 0)
    at = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(sizes)), count), points[at] << 42 | points[at + 1] << 21 | points[at + 2]


def _gram_rows(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``row, gram, tf`` of a batch's texts, each gram of a row once."""
    parts = [_windows(batch[c]) for c in columns]
    row, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
    different, code = np.unique(gram, return_inverse=True)
    key, tf = np.unique(row * max(1, len(different)) + code, return_counts=True)
    row, code = np.divmod(key, max(1, len(different)))
    names = np.stack([different >> 42, different >> 21 & 0x1FFFFF, different & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    spelled = pa.array([names[k:k + GRAM] for k in range(0, len(names), GRAM)], pa.string())
    return row, spelled.take(pa.array(code, pa.int64())), tf


def _by_batch(items: DataFrame, id_col: str, columns: list[str], tail: str, counted: bool, marks: bool = False) -> DataFrame:
    texts = items.select(F.col(id_col), *[F.concat(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(tail)).alias(f"_{k}") for k, c in enumerate(columns)])
    names = [f"_{k}" for k in range(len(columns))]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                row, gram, tf = _gram_rows(part, names)
                if marks:
                    bare = np.setdiff1d(np.arange(part.num_rows), row)
                    row, tf = np.concatenate([row, bare]), np.concatenate([tf, np.zeros(len(bare), np.int64)])
                    gram = pa.concat_arrays([gram, pa.array([""] * len(bare), pa.string())])
                out = {"gram": gram, id_col: part[id_col].take(pa.array(row, pa.int64())), **({"tf": pa.array(tf)} if counted else {})}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return texts.mapInArrow(run, f"gram string, {id_col} {dict(items.dtypes)[id_col]}" + (", tf long" if counted else ""))


def gram_postings(items: DataFrame, id_col: str, columns: list[str], marks: bool = False) -> DataFrame:
    """``gram, id, tf`` over all character trigrams of the given text columns, lower-cased.

    With ``marks`` an item too short for a gram has one row of an empty gram and no count, so the postings tell that it was indexed.
    """
    return _by_batch(items, id_col, columns, "", True, marks)


def gram_sets(items: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``gram, id`` for lookups: each gram of an item once, with grams that run over the end of a text."""
    return _by_batch(items, id_col, columns, PAD, False)


def word_postings(items: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``word, id, tf`` over Unicode words, for texts a trigram index does not suit."""
    words = F.flatten(F.array(*[F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+") for c in columns]))
    return _counted(items, id_col, F.filter(words, lambda w: w != ""), "word")


def doc_length(columns: list[str]) -> Column:
    """Trigrams of an item, the length BM25 normalises by."""
    total = F.lit(0).cast("bigint")
    for c in columns:
        total = total + F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - (GRAM - 1), F.lit(0))
    return total


def gram_statistics(postings: DataFrame, gram: str = "gram") -> DataFrame:
    """Document frequency and total count per gram; map-side combine keeps hot grams cheap."""
    return postings.groupBy(gram).agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def write_index(postings: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite", id_col: str = "chunk_id") -> None:
    """Persist postings by gram bucket, sorted by gram for parquet min/max skipping."""
    placed = postings.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    (
        placed.repartitionByRange(F.col("bucket"), F.col("gram"), F.col(id_col)).sortWithinPartitions("bucket", "gram")
        .write.mode(mode).partitionBy("bucket").parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def backfill(items: DataFrame, postings: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Postings that match the items again: those of vanished items leave, items without any are indexed and appended."""
    kept = postings.join(items.select(id_col).distinct(), id_col, "left_semi")
    new = gram_postings(missing_from_index(items, postings, id_col), id_col, columns)
    return kept.unionByName(new.select(*postings.columns))


def missing_from_index(items: DataFrame, postings: DataFrame, id_col: str) -> DataFrame:
    """Items without postings, to be indexed and appended. Postings with marks also know the items that are too short for a gram.

    The distinct ids of the index are combined map-side before the anti-join.
    """
    return items.join(postings.select(id_col).distinct(), id_col, "left_anti")

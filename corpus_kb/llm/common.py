"""Small helpers of this subpackage: Arrow batches, labels by fold, integer draws."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_kb.session import materialize

__all__ = ["arrow_map", "binary_text", "fold", "labelled", "materialize", "small_batches", "table", "tokenizer_path", "whole_words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    """Place of a vocabulary file; the folder is a parameter and holds the same files on every machine."""
    return f"{folder}/{name}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside, so a worker holds few long texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def binary_text(column: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def whole_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def arrow_map(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict], **kwargs) -> DataFrame:
    """``rows`` turns each Arrow batch into columns by name, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in target], schema=target
            )

    return df.mapInArrow(run, schema, **kwargs)


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; null ids count as held out (0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label a document: repeated rows vote, ties count as 1; null ids and null labels go."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label"))


def rng_of(*words: int) -> np.random.Generator:
    return np.random.default_rng([int(w) & 0xFFFFFFFF for w in words])

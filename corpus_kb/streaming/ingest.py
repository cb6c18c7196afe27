"""Structured Streaming jobs. Each equals its batch twin on replayed input.

State that could grow for ever is bounded by a watermark of ten minutes, where later rows are dropped, or is not kept at all.
Checkpoints and outputs live in folders the caller names, on storage all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpus_kb.functions.transcripts import canonical_arguments
from corpus_kb.operators.segment import chunk_pages

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of a folder, one file or a folder of parts, as a file stream with an explicit schema.

    The path is a pattern that only the table matches: a stream reads a single file by a pattern only.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def run_to_end(rows: DataFrame, out: str, mode: str = "append") -> StreamingQuery:
    """Append a stream's rows to a parquet folder until the available input is used up."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return query


def fold_batches(rows: DataFrame, out: str, mode: str, land: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Land each micro-batch in its own folder; a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        land(batch, f"{out}/rows/batch={batch_id}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def write_rows(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def ingest_pages(pages: DataFrame, out: str, target_tokens: int = 512) -> StreamingQuery:
    """Chunk pages (``path, body``) as they land. Chunking is stateless; each batch also logs its pages."""

    def land(batch: DataFrame, path: str) -> None:
        write_rows(batch.select("path", F.sha2("body", 256).alias("body_hash")), path.replace("/rows/", "/pages/"))
        write_rows(chunk_pages(batch.select("path", "body"), target_tokens=target_tokens), path)

    return fold_batches(pages, out, "append", land)


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of each page's newest batch; a page that came again without chunks has none."""
    newest = spark.read.parquet(f"{out}/pages").groupBy(F.col("path").alias("page_path")).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/rows").join(newest, ["page_path", "batch"], "left_semi").drop("batch")


def silent_holders(beats: DataFrame, holder: str, at: str, gap: str = "90 seconds") -> DataFrame:
    """Holders that fell silent: a session of heartbeats closes once the gap has passed without one."""
    return (
        beats.withWatermark(at, WATERMARK).groupBy(holder, F.session_window(at, gap).alias("session"))
        .agg(F.count("*").alias("beats"), F.max(at).alias("last_beat")).select(holder, "last_beat", "beats")
    )


def fold_parts(rows: DataFrame, out: str, fold: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Land what ``fold`` makes of each micro-batch. The stream keeps no state at all: ``fold`` is mergeable, its parts are folded again when they are read.

    Ended runs therefore cost nothing any more, and rows that come late or out of order count as in one batch.
    """
    return fold_batches(rows, out, "append", lambda batch, path: write_rows(fold(batch), path))


def run_status(events: DataFrame) -> DataFrame:
    """Latest status per run; mergeable. Of statuses with one ``seq`` the greatest counts."""
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("seq", "status")).alias("status"), F.max("seq").alias("seq"))


def progress(reports: DataFrame) -> DataFrame:
    """Counters per run and outcome; :func:`total_progress` adds up the parts."""
    return reports.groupBy("run_id", "outcome").agg(F.count("*").alias("n"))


def total_progress(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run_id", "outcome").agg(F.sum("n").alias("n"))


def fresh_calls(calls: DataFrame, at: str = "ts") -> DataFrame:
    """Calls without repeats of the same name and arguments, whatever the order of their keys, in a conversation within the watermark."""
    keyed = calls.withColumn("call_key", canonical_arguments(F.col("args")))
    return keyed.withWatermark(at, WATERMARK).dropDuplicatesWithinWatermark(["conv", "name", "call_key"]).drop("call_key")


def token_accounts(calls: DataFrame, at: str = "created_at", width: str = "7 days") -> DataFrame:
    """Tokens per run and time window; a window is emitted and its state freed once the watermark passes it."""
    return (
        calls.withWatermark(at, WATERMARK).groupBy(F.window(at, width).alias("w"), "run_id")
        .agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens"))
        .select(F.col("w.start").alias("window_start"), "run_id", "calls", "prompt_tokens", "cached_tokens")
    )


class _Rollback(StatefulProcessor):
    """Holds the deltas since a conversation's last mark; a mark releases them, a reset drops them.

    The next mark or reset after a delta decides it, found for all rows of a trigger at once by binary search. Held deltas are only read
    when one comes; until then new ones are appended.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getListState("open", "seq bigint, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seq, kind, text = batch["seq"].to_numpy(), batch["kind"].to_numpy(), batch["text"].to_numpy(dtype=object)
        deltas, decisive = np.flatnonzero(kind == "delta"), np.flatnonzero(kind != "delta")
        decided_by = np.searchsorted(decisive, deltas)
        still_open = deltas[decided_by == len(decisive)]
        left = list(zip(seq[still_open].tolist(), text[still_open]))
        if not len(decisive):
            self._open.appendList(left)
            return
        held = list(self._open.get()) if kind[decisive[0]] == "mark" and self._open.exists() else []
        if left:
            self._open.put(left)
        else:
            self._open.clear()
        decided = decided_by < len(decisive)
        released = deltas[decided][kind[decisive[decided_by[decided]]] == "mark"]
        if held or len(released):
            yield pd.DataFrame({
                "conv": key[0], "seq": np.concatenate([np.array([h[0] for h in held], dtype="int64"), seq[released]]),
                "text": np.concatenate([np.array([h[1] for h in held], dtype=object), text[released]]),
            })

    def close(self) -> None:
        pass


def committed_deltas(events: DataFrame) -> DataFrame:
    """Deltas closed by a mark, as they commit: ``conv, seq, text``. Triggers come in ``seq`` order of each conversation.

    State holds one open round per conversation, not its text; size a trigger with ``maxFilesPerTrigger``.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.select("conv", "seq", "kind", "text").groupBy("conv").transformWithStateInPandas(
        statefulProcessor=_Rollback(), outputStructType="conv bigint, seq bigint, text string", outputMode="Append", timeMode="None",
    )

"""End of a run: prune what vanished, count, list, check, mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpus_kb.operators import delta
from corpus_kb.operators.quality import integrity_problems
from corpus_kb.operators.runs import table_counts
from corpus_kb.sources.sinks import index_lines


def finalize(pages: DataFrame, chunks: DataFrame, postings: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables a run leaves behind: ``pages, chunks, postings, index, problems, summary``.

    ``pages`` holds ``path, title, description, body``. All frames are lazy; write those you need.
    """
    kept, kept_chunks, kept_postings = delta.prune(pages, chunks, postings, files)
    problems = integrity_problems(kept)
    summary = table_counts(pages=kept, chunks=kept_chunks, pruned=delta.vanished(pages, files), problems=problems)
    return {
        "pages": kept, "chunks": kept_chunks, "postings": kept_postings, "index": index_lines(kept),
        "problems": problems, "summary": summary,
    }


def high_water_mark(runs: DataFrame) -> DataFrame:
    """One row about the newest finished run, the state the next no-op check compares with."""
    fields = [c for c in ("run_id", "git_head", "model", "language") if c in runs.columns]
    done = runs.filter(F.col("status") == "succeeded")
    return done.agg(F.max_by(F.struct("created_at", *fields), F.struct("created_at", "run_id")).alias("r")).select("r.*")


MARK = "run_id string, head string, finished timestamp, pages long, chunks long, postings long, index long, problems long, pruned long"
FRAMES = ("pages", "chunks", "postings", "index", "problems")


def finish_run(pages: DataFrame, chunks: DataFrame, postings: DataFrame, files: DataFrame, path: str, run_id: str, head: str) -> dict[str, DataFrame]:
    """Write what a run leaves behind below ``path`` and mark the run as finished; returns the written frames.

    Rows are counted by the pass that writes them. The mark is the last thing written, so a run that died before has none and
    the next gate does not trust it; a repeated run overwrites its own folder.
    """
    spark = pages.sparkSession
    frames = finalize(pages, chunks, postings, files)
    counts = {}
    for name in FRAMES:
        seen = Observation(name)
        frames[name].observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}/{run_id}")
        counts[name] = seen.get["rows"]
    pruned = delta.vanished(pages, files).count()
    mark = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(head).alias("head"), F.current_timestamp().alias("finished"), *(F.lit(counts[n]).cast("long").alias(n) for n in FRAMES), F.lit(pruned).cast("long").alias("pruned"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/run={run_id}")
    return {name: spark.read.parquet(f"{path}/{name}/{run_id}") for name in FRAMES}


def marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks of all finished runs."""
    return spark.read.schema(MARK).option("recursiveFileLookup", "true").parquet(f"{path}/marks")


def gate(changed: DataFrame, finished: DataFrame, head: Column) -> DataFrame:
    """One row: whether a run has nothing to do, by the newest mark and the paths changed since (column ``path``); without a mark it has."""
    last = finished.agg(F.max_by("head", F.struct("finished", "run_id")).alias("last_head")).scalar()
    return delta.is_no_op(changed, last, head).select("relevant", F.coalesce("no_op", F.lit(False)).alias("no_op"))

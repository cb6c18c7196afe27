"""Run ledger and call log: rollups, cache accounting, status reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_kb.functions.transcripts import canonical_arguments

# fixed values
HIGHLIGHT_TYPES = ["Architecture", "Data Model", "API Reference", "Business", "Workflow"]
STALE_SECONDS = 90


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per table, one row each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def run_rollup(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs with the sums of their calls; calls are summed before they meet the runs."""
    sums = calls.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens")
    )
    return runs.join(sums, "run_id", "left").select(
        "run_id", "status", F.coalesce("calls", F.lit(0)).alias("calls"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("cached_tokens", F.lit(0)).alias("cached_tokens"),
    )


def run_totals(reports: DataFrame) -> DataFrame:
    """Per run: token sums, pages per outcome, chunks (``run_id, path, outcome, prompt_tokens, chunks``)."""
    return reports.groupBy("run_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("chunks").alias("chunks"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("generated", "reused", "template", "kept_previous")],
    )


def run_pages(reports: DataFrame) -> DataFrame:
    """Pages a run wrote or kept, as rows: ``run_id, kind, path``. A run's pages are never collected in one place."""
    kind = F.when(F.col("outcome").isin("generated", "template"), F.lit("written")).otherwise(F.lit("kept"))
    return reports.select("run_id", kind.alias("kind"), "path")


def cache_accounting(lookups: DataFrame, scope: str, key: list[str]) -> DataFrame:
    """Per scope: lookups, misses (first use of a key), hits, hit rate. Repeats of a hot key combine map-side."""
    per_key = lookups.groupBy(scope, *key).agg(F.count("*").alias("n"))
    out = per_key.groupBy(scope).agg(F.sum("n").alias("lookups"), F.count("*").alias("misses"))
    hits = F.col("lookups") - F.col("misses")
    return out.select(scope, "lookups", "misses", hits.alias("hits"), F.coalesce(F.try_divide(hits, F.col("lookups")), F.lit(0.0)).alias("hit_rate"))


def prompt_cache(calls: DataFrame, *by: str) -> DataFrame:
    """Share of prompt tokens served from the provider's cache."""
    sums = calls.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens"))
    return sums.withColumn("ratio", F.coalesce(F.try_divide(F.col("cached_tokens"), F.col("prompt_tokens")), F.lit(0.0)))


def first_errors(log: DataFrame, scope: str, seq: str) -> DataFrame:
    """Earliest error of each scope."""
    return log.filter(F.col("error").isNotNull()).groupBy(scope).agg(F.min_by("error", seq).alias("error"), F.min(seq).alias(seq))


def flag_duplicates(calls: DataFrame, scope: str, seq: str) -> DataFrame:
    """Calls flagged ``fresh`` on the first use of (name, canonical arguments) in their scope.

    First uses come from a map-side ``min``; they meet the calls on (scope, seq), which names a call also where
    seq starts anew in every scope, so a call that makes up a third of the log never gathers in one task.
    """
    keyed = calls.withColumn("call_key", canonical_arguments(F.col("args")))
    firsts = keyed.groupBy(scope, "name", "call_key").agg(F.min(seq).alias(seq)).select(scope, seq, F.lit(True).alias("fresh"))
    return keyed.join(firsts, [scope, seq], "left").select(scope, seq, "name", "call_key", F.coalesce("fresh", F.lit(False)).alias("fresh"))


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def latest_run_per(runs: DataFrame, *by: str) -> DataFrame:
    """Latest run of each group without a window: structs compare by (created_at, run_id)."""
    return runs.groupBy(*by).agg(F.max(F.struct("created_at", "run_id", "status")).alias("r")).select(
        *by, F.col("r.run_id").alias("run_id"), F.col("r.status").alias("status"), F.col("r.created_at").alias("created_at")
    )


def fail_stale_runs(runs: DataFrame, as_of: Column, max_age: Column, error: str = "interrupted") -> DataFrame:
    """Running runs older than the cutoff become failed, finished at ``as_of``, keeping an earlier error."""
    stale = (F.col("status") == "running") & (F.col("created_at") <= as_of - max_age)
    return runs.withColumns({
        "error": F.when(stale, F.coalesce("error", F.lit(error))).otherwise(F.col("error")),
        "finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")),
        "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
    })


def run_states(events: DataFrame) -> DataFrame:
    """Latest state per run from begin and finish events (``run_id, seq, status, git_head, at``).

    Status follows the newest event, the head is the newest one given, begin and end come from the extremes.
    """
    head = F.max(F.when(F.col("git_head").isNotNull(), F.struct("seq", "git_head")))
    return events.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"), head.alias("h"), F.min("at").alias("created_at"),
        F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"),
    ).select("run_id", "status", F.col("h.git_head").alias("git_head"), "created_at", "finished_at")


def stale_holders(beats: DataFrame, holder: str, at: str, as_of: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Holders whose last heartbeat is older than the limit."""
    last = beats.groupBy(holder).agg(F.max(at).alias("last_beat"))
    return last.withColumn("stale", F.col("last_beat") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def progress(reports: DataFrame, *by: str) -> DataFrame:
    return reports.groupBy(*by).agg(F.count("*").alias("n"))


def highlights(pages: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """First existing page of each wanted type in type order: ``prio, page_type, path, title``.

    At most one row per wanted type leaves the aggregation.
    """
    prio = F.array_position(F.array(*[F.lit(t) for t in HIGHLIGHT_TYPES]), F.col("page_type"))
    first = (
        pages.filter(F.col("page_type").isin(*HIGHLIGHT_TYPES)).join(files.select("path").distinct(), "path", "left_semi")
        .groupBy(prio.cast("bigint").alias("prio"), "page_type").agg(F.min(F.struct("path", "title")).alias("p"))
    )
    kept = first if limit is None else first.orderBy("prio").limit(limit)
    return kept.select("prio", "page_type", F.col("p.path").alias("path"), F.col("p.title").alias("title"))


def project_card(pages: DataFrame, chunks: DataFrame, entities: DataFrame, runs: DataFrame) -> DataFrame:
    """One row about a project from scalar subqueries over its tables."""
    spark = pages.sparkSession
    count = lambda df: df.agg(F.count("*").alias("n")).select("n").scalar()
    last = runs.agg(F.max(F.struct("created_at", "run_id", "status")).alias("r"))
    entry = pages.filter(F.col("path").isin("quickstart.md", "README.md")).agg(F.max("path").alias("p"))
    return spark.range(1).select(
        count(pages).alias("pages"), count(chunks).alias("chunks"), count(entities.filter(F.col("status") == "active")).alias("entities"),
        count(runs).alias("runs"), last.select("r.status").scalar().alias("last_status"), last.select("r.created_at").scalar().alias("updated_at"),
        F.coalesce(entry.select("p").scalar(), F.lit("")).alias("entry_path"),
    )

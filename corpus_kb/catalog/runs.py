"""Run and call-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.operators import runs as U
from corpus_kb.sources import tables as T

AS_OF = "2001-08-01 00:00:00"


def reports(spark, d):
    """Page reports of a run: one per call, its outcome by return flag and quantity."""
    outcome = F.when(F.col("stage") == "A", "generated").when(F.col("stage") == "R", "reused").when(F.col("prompt_tokens") % 2 == 0, "template").otherwise("kept_previous")
    return T.calls(spark, d).select("run_id", F.concat(F.lit("p"), F.col("call_no").cast("string")).alias("path"), outcome.alias("outcome"), "prompt_tokens", F.col("call_no").alias("chunks"))


_OUTCOME = "CASE stage WHEN 'A' THEN 'generated' WHEN 'R' THEN 'reused' ELSE CASE WHEN prompt_tokens % 2 = 0 THEN 'template' ELSE 'kept_previous' END END"


def stale(spark, d):
    r = T.runs(spark, d).withColumn("error", F.when(F.col("run_id") % 2 == 0, "old error")).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    done = U.fail_stale_runs(r, F.lit(AS_OF).cast("timestamp_ntz"), F.expr("INTERVAL '900' DAY"))
    return done.select("run_id", "status", "error", F.date_format("finished_at", "yyyy-MM-dd").alias("finished"))


def run_events(spark, d):
    """Begin and finish events of each run; heads are given by some events only."""
    r = T.runs(spark, d)
    begin = r.select("run_id", F.lit(0).cast("bigint").alias("seq"), F.lit("running").alias("status"), F.concat(F.lit("h"), F.col("run_id").cast("string")).alias("git_head"), F.col("created_at").alias("at"))
    finish = r.filter(F.col("status") != "running").select(
        "run_id", F.lit(1).cast("bigint").alias("seq"), "status", F.when(F.col("run_id") % 2 == 0, F.lit("new")).alias("git_head"),
        (F.col("created_at") + F.expr("INTERVAL '1' DAY")).alias("at"),
    )
    return begin.unionByName(finish)


def run_states(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return U.run_states(run_events(spark, d)).select("run_id", "status", "git_head", day("created_at"), day("finished_at"))


def heartbeats(spark, d):
    e = T.table(spark, d, "events")
    as_of = e.agg(F.max("ts").alias("m")).select("m").scalar()
    return U.stale_holders(e, "user_id", "ts", as_of, 6 * 3600).select("user_id", "stale")


def typed_pages(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Reference", "Workflow", "Business", "Architecture", "Data Model", "API Reference")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return T.docs(spark, d).select("path", kind.alias("page_type"), F.col("lang").alias("title"), "lang")


_TYPED = "SELECT path, lang, CASE doc_id % 6 WHEN 0 THEN 'Reference' WHEN 1 THEN 'Workflow' WHEN 2 THEN 'Business' WHEN 3 THEN 'Architecture' WHEN 4 THEN 'Data Model' ELSE 'API Reference' END AS page_type FROM f_docs"


ENTRIES = {
    "A1_table_counts": (
        lambda s, d: U.table_counts(pages=T.docs(s, d), chunks=T.chunks(s, d), entities=T.entities(s, d).filter(F.col("status") == "active"), runs=T.runs(s, d)),
        with_views("""SELECT 'pages' AS "table", count(*) AS rows FROM f_docs UNION ALL SELECT 'chunks', count(*) FROM f_cut UNION ALL SELECT 'entities', count(*) FROM f_entities WHERE status = 'active' UNION ALL SELECT 'runs', count(*) FROM f_runs"""),
    ),
    "J13_run_call_rollup": (
        lambda s, d: U.run_rollup(T.runs(s, d), T.calls(s, d)),
        with_views("SELECT r.run_id, r.status, count(c.run_id) AS calls, coalesce(sum(prompt_tokens), 0)::bigint AS prompt_tokens, coalesce(sum(cached_tokens), 0)::bigint AS cached_tokens FROM f_runs r LEFT JOIN f_calls c ON r.run_id = c.run_id GROUP BY r.run_id, r.status"),
    ),
    "A9_run_totals": (
        lambda s, d: U.run_totals(reports(s, d)),
        with_views(f"""SELECT run_id, sum(prompt_tokens)::bigint AS prompt_tokens, sum(call_no)::bigint AS chunks, count(*) FILTER (o = 'generated') AS generated, count(*) FILTER (o = 'reused') AS reused,
            count(*) FILTER (o = 'template') AS template, count(*) FILTER (o = 'kept_previous') AS kept_previous FROM (SELECT *, {_OUTCOME} AS o FROM f_calls) GROUP BY run_id"""),
    ),
    "A9_run_pages": (
        lambda s, d: U.run_pages(reports(s, d)),
        with_views(f"SELECT run_id, CASE WHEN o IN ('generated', 'template') THEN 'written' ELSE 'kept' END AS kind, 'p' || call_no AS path FROM (SELECT *, {_OUTCOME} AS o FROM f_calls)"),
    ),
    "A10_cache_accounting": (
        lambda s, d: U.cache_accounting(T.tool_log(s, d), "conv", ["name", "args"]).withColumn("hit_rate", F.round("hit_rate", 6)),
        with_views("""SELECT conv, count(*) AS lookups, count(DISTINCT (name, args)) AS misses, count(*) - count(DISTINCT (name, args)) AS hits, round((count(*) - count(DISTINCT (name, args))) / count(*), 6) AS hit_rate FROM f_tools GROUP BY conv"""),
    ),
    "A11_prompt_cache_ratio": (
        lambda s, d: U.prompt_cache(T.calls(s, d), "stage").withColumn("ratio", F.round("ratio", 6)),
        with_views("SELECT stage, sum(prompt_tokens)::bigint AS prompt_tokens, sum(cached_tokens)::bigint AS cached_tokens, round(sum(cached_tokens) / sum(prompt_tokens), 6) AS ratio FROM f_calls GROUP BY stage"),
    ),
    "A20_first_error": (
        lambda s, d: U.first_errors(T.tool_log(s, d).withColumn("error", F.when(F.col("name") == "error", F.col("args"))), "conv", "seq"),
        with_views("SELECT conv, arg_min(args, seq) AS error, min(seq) AS seq FROM f_tools WHERE name = 'error' GROUP BY conv"),
    ),
    "W12_F13_duplicate_calls": (
        lambda s, d: U.flag_duplicates(T.tool_log(s, d), "conv", "seq"),
        with_views("""SELECT conv, seq, name, concat('{"k":', json_extract_string(args, '$.k'), '}') AS call_key, row_number() OVER (PARTITION BY conv, name, args ORDER BY seq) = 1 AS fresh FROM f_tools"""),
    ),
    "L2_newest_runs": (
        lambda s, d: U.newest_runs(T.runs(s, d), 20).select("run_id", "status", "mode"),
        with_views("SELECT run_id, status, mode FROM f_runs ORDER BY created_at DESC, run_id DESC LIMIT 20"),
    ),
    "W18_latest_run": (
        lambda s, d: U.latest_run_per(T.runs(s, d), "mode").select("mode", "run_id", "status"),
        with_views("SELECT mode, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY created_at DESC, run_id DESC) AS rn FROM f_runs) WHERE rn = 1"),
    ),
    "U9_F21_stale_runs": (
        stale,
        with_views(f"""SELECT run_id, CASE WHEN st THEN 'failed' ELSE status END AS status, coalesce(CASE WHEN run_id % 2 = 0 THEN 'old error' END, CASE WHEN st THEN 'interrupted' END) AS error,
            CASE WHEN st THEN '2001-08-01' END AS finished FROM (SELECT *, status = 'running' AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY AS st FROM f_runs)"""),
    ),
    "U10_run_states": (
        run_states,
        with_views("""SELECT run_id, status, CASE WHEN status <> 'running' AND run_id % 2 = 0 THEN 'new' ELSE 'h' || run_id END AS git_head, strftime(created_at, '%Y-%m-%d') AS created_at,
            CASE WHEN status <> 'running' THEN strftime(created_at + INTERVAL 1 DAY, '%Y-%m-%d') END AS finished_at FROM f_runs"""),
    ),
    "T2_heartbeat_staleness_batch": (
        heartbeats,
        "SELECT user_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS stale FROM events GROUP BY user_id",
    ),
    "J16_highlights": (
        lambda s, d: U.highlights(typed_pages(s, d), typed_pages(s, d).filter(F.col("lang") != "en"), 4).select("page_type", "path", "title"),
        with_views("""SELECT page_type, path, title FROM (SELECT page_type, min(path) AS path, arg_min(lang, path) AS title, list_position(['Architecture', 'Data Model', 'API Reference', 'Business', 'Workflow'], page_type) AS prio
            FROM typed WHERE page_type <> 'Reference' AND lang <> 'en' GROUP BY page_type ORDER BY prio LIMIT 4)""", typed=_TYPED),
    ),
    "A16_project_card": (
        lambda s, d: U.project_card(T.docs(s, d), T.chunks(s, d), T.entities(s, d), T.runs(s, d)).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd")),
        with_views("""SELECT (SELECT count(*) FROM f_docs) AS pages, (SELECT count(*) FROM f_cut) AS chunks, (SELECT count(*) FROM f_entities WHERE status = 'active') AS entities, (SELECT count(*) FROM f_runs) AS runs,
            (SELECT status FROM f_runs ORDER BY created_at DESC, run_id DESC LIMIT 1) AS last_status, (SELECT strftime(max(created_at), '%Y-%m-%d') FROM f_runs) AS updated_at, '' AS entry_path"""),
    ),
}

"""Streaming queries, replayed over the given tables to the end, and sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from corpus_kb import schemas
from corpus_kb.catalog.base import with_views
from corpus_kb.catalog.conversation import _DELTAS, _ROUNDS
from corpus_kb.catalog.delta import _CLAIMS as CLAIMS
from corpus_kb.catalog.segment import _CHUNKED as CHUNKED, _GROUPED as GROUPED, _MERGED as MERGED, _PIECES as PIECES, _WALK as WALK, with_claims
from corpus_kb.operators import runs as U
from corpus_kb.session import shared_dir
from corpus_kb.sources import tables as T
from corpus_kb.streaming import ingest as S
from corpus_kb.streaming import landing as L

_ORDERS = TY.StructType([
    TY.StructField("o_orderkey", TY.LongType()), TY.StructField("o_orderstatus", TY.StringType()),
    TY.StructField("o_orderpriority", TY.StringType()), TY.StructField("o_orderdate", TY.TimestampNTZType()),
])
_LINEITEM = TY.StructType([
    TY.StructField("l_orderkey", TY.LongType()), TY.StructField("l_linenumber", TY.IntegerType()), TY.StructField("l_quantity", TY.DoubleType()),
    TY.StructField("l_discount", TY.DoubleType()), TY.StructField("l_returnflag", TY.StringType()), TY.StructField("l_shipdate", TY.TimestampNTZType()),
])


def ingest(spark, d):
    """Markdown pages with claims land as they come; one row per page over all tables that landed."""
    land = L.Landing(spark, shared_dir(spark, "ingest"))
    docs = S.table_stream(spark, d, "documents", schemas.DOCUMENTS)
    pages = with_claims(T.markdown(T.as_docs(docs)))
    module = F.when(F.col("lang") != "fr", F.col("source"))
    L.land_stream(land, pages.select("path", F.col("lang").alias("repo"), module.alias("module"), "body"))
    chunks = land.current("chunks")
    cut = chunks.groupBy("page_path").agg(
        F.count("*").alias("chunks"), F.min("start_line").alias("first"), F.max("end_line").alias("last"), F.min("chunk_id").alias("least_chunk"), F.max("chunk_id").alias("greatest_chunk"))
    grams = land.index().postings().groupBy("chunk_id").agg(F.count("*").alias("n")).join(chunks.select("chunk_id", "page_path"), "chunk_id").groupBy("page_path").agg(F.sum("n").alias("grams"))
    stated = land.current("claims").groupBy("page_path").agg(F.count("*").alias("claims"), F.sum(F.length("statement")).alias("claim_chars"))
    edges = land.current("describes").select(F.col("path").alias("page_path"), F.col("dst").alias("describes"))
    found = land.current("pages").select(F.col("path").alias("page_path"), "body_hash")
    for part in (cut, grams, stated, edges):
        found = found.join(part, "page_path", "left")
    return found.na.fill(0, ["chunks", "grams", "claims", "claim_chars"])


def silent(spark, d):
    out = shared_dir(spark, "beats")
    e = S.table_stream(spark, d, "events", schemas.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    S.run_to_end(S.silent_holders(e, "user_id", "ts", "6 hours"), out)
    return spark.read.parquet(f"{out}/rows").select("user_id", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"), "beats")


def deltas(spark, d):
    out = shared_dir(spark, "deltas")
    kind = F.when(F.col("event_type") == "signup", "mark").when(F.col("event_type") == "error", "reset").otherwise("delta")
    e = S.table_stream(spark, d, "events", schemas.EVENTS).select(F.col("user_id").alias("conv"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("text"))
    S.run_to_end(S.committed_deltas(e), out)
    return spark.read.parquet(f"{out}/rows").select("conv", "seq", "text")


def run_status(spark, d):
    out = shared_dir(spark, "status")
    o = S.table_stream(spark, d, "orders", _ORDERS)
    final = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    steps = F.array(F.struct(F.lit(0).alias("seq"), F.lit("running").alias("status")), F.struct(F.lit(1).alias("seq"), final.alias("status")))
    S.fold_parts(o.select(F.col("o_orderkey").alias("run_id"), F.inline(steps)), out, S.run_status)
    return S.run_status(spark.read.parquet(f"{out}/rows")).select("run_id", "status")


def progress(spark, d):
    out = shared_dir(spark, "progress")
    c = S.table_stream(spark, d, "lineitem", _LINEITEM)
    S.fold_parts(c.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("outcome")), out, S.progress)
    return S.total_progress(spark.read.parquet(f"{out}/rows"))


def fresh(spark, d):
    out = shared_dir(spark, "fresh")
    e = S.table_stream(spark, d, "events", schemas.EVENTS).select(F.col("user_id").alias("conv"), F.col("event_type").alias("name"), F.col("props").alias("args"), F.col("ts").cast("timestamp").alias("ts"))
    S.run_to_end(S.fresh_calls(e), out)
    return spark.read.parquet(f"{out}/rows").select("conv", "name", "args")


def tokens(spark, d):
    out = shared_dir(spark, "tokens")
    c = S.table_stream(spark, d, "lineitem", _LINEITEM).select(
        F.col("l_orderkey").alias("run_id"), F.floor("l_quantity").cast("bigint").alias("prompt_tokens"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("bigint").alias("cached_tokens"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )
    S.run_to_end(S.token_accounts(c), out)
    return spark.read.parquet(f"{out}/rows").select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "run_id", "calls", "prompt_tokens", "cached_tokens")


def appended_log(spark, d):
    """Call log written by two appends and read back."""
    out, c = shared_dir(spark, "calls"), T.calls(spark, d)
    for part in (c.filter(F.col("stage") == "R"), c.filter(F.col("stage") != "R")):
        part.write.mode("append").parquet(out)
    return U.prompt_cache(spark.read.schema(c.schema).parquet(out), "stage").select("stage", "prompt_tokens", "cached_tokens")


_SESSIONS = """SELECT user_id, count(*) AS beats, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM
    (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid"""

ENTRIES = {
    "T1_stream_ingest": (
        ingest,
        with_views("""SELECT d.path AS page_path, h.body_hash, coalesce(chunks, 0) AS chunks, first, last, least_chunk, greatest_chunk, coalesce(grams, 0)::bigint AS grams, coalesce(claims, 0) AS claims,
              coalesce(claim_chars, 0)::bigint AS claim_chars, CASE WHEN lang <> 'fr' THEN concat('module:', lang, '/', source) END AS describes FROM f_docs d
            LEFT JOIN (SELECT path, sha256(string_agg(line, chr(10) ORDER BY line_no) || chr(10)) AS body_hash FROM claim_lines GROUP BY path) h ON h.path = d.path
            LEFT JOIN (SELECT page_path, count(*) AS chunks, min(start_line) AS first, max(end_line) AS last, min(chunk_id) AS least_chunk, max(chunk_id) AS greatest_chunk FROM cut GROUP BY page_path) c ON c.page_path = d.path
            LEFT JOIN (SELECT page_path, count(*) AS grams FROM (SELECT DISTINCT page_path, chunk_id, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM
                (SELECT page_path, chunk_id, lower(unnest([title, summary, body])) || chr(1) || chr(1) AS t FROM cut)) GROUP BY page_path) g ON g.page_path = d.path
            LEFT JOIN (SELECT page_path, count(*) AS claims, sum(length(statement)) AS claim_chars FROM claims GROUP BY page_path) s ON s.page_path = d.path""",
            claim_lines="""SELECT path, line_no, CASE WHEN regexp_matches(line, '^## [A-M]') THEN '## Claims ' || substr(line, 4) WHEN line <> '' AND NOT regexp_matches(line, '^[#`]') THEN '- ' || line ELSE line END AS line FROM f_md""",
            fence="SELECT path, line_no, line, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) % 2 = 1 AS in_fence FROM claim_lines",
            walk=WALK.replace("f_fence", "fence"), pieces=PIECES, grouped=GROUPED, merged=MERGED, cut=CHUNKED, claims=CLAIMS),
    ),
    "T2_stream_silent_holders": (
        silent,
        with_views("SELECT user_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_beat, beats FROM sess WHERE last_ts + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)", sess=_SESSIONS),
    ),
    "T3_stream_delta_fold": (
        deltas,
        with_views("SELECT conv, seq, text FROM deltas WHERE kind = 'delta' AND round < last_round AND (last_reset IS NULL OR seq > last_reset)", rounds=_ROUNDS, deltas=_DELTAS),
    ),
    "T4_stream_run_status": (run_status, with_views("SELECT run_id, status FROM f_runs")),
    "T5_stream_progress": (progress, with_views("SELECT run_id, stage AS outcome, count(*) AS n FROM f_calls GROUP BY run_id, stage")),
    "T7_stream_fresh_calls": (fresh, with_views("SELECT DISTINCT conv, name, args FROM f_tools")),
    "T8_stream_token_accounts": (
        tokens,
        with_views("""SELECT strftime(w, '%Y-%m-%d') AS window_start, run_id, count(*) AS calls, sum(prompt_tokens)::bigint AS prompt_tokens, sum(cached_tokens)::bigint AS cached_tokens FROM
            (SELECT *, time_bucket(INTERVAL 7 DAY, created_at, TIMESTAMP '1970-01-01') AS w FROM f_calls) WHERE w + INTERVAL 7 DAY <= (SELECT max(created_at) - INTERVAL 10 MINUTE FROM f_calls) GROUP BY w, run_id"""),
    ),
    "U11_call_log_append": (
        appended_log, with_views("SELECT stage, sum(prompt_tokens)::bigint AS prompt_tokens, sum(cached_tokens)::bigint AS cached_tokens FROM f_calls GROUP BY stage"),
    ),
}

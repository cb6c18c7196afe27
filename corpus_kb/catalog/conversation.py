"""Transcript and prose queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.functions.transcripts import DRAFT_MARKER, INVOKE, JSON_CALL_MARKS, canonical_arguments
from corpus_kb.operators import conversation as V
from corpus_kb.sources import tables as T


def transcripts(spark, d):
    """Assistant turns that call a tool in text: closed calls, unclosed ones and clean prose by conversation."""
    call = F.concat(
        F.lit("<tool_call>\n<function=read_file>\n<parameter=path>\n"), "role", F.lit("/a.rs\n</parameter>\n<parameter name=\"start_line\">"),
        F.col("turn").cast("string"), F.lit("</parameter>\n</function>\n</tool_call>\n"),
    )
    text = (
        F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("\n"), call, F.lit("END")))
        .when(F.col("conv_id") % 3 == 1, F.concat("text", F.lit("\n<tool_call>\nleft over")))
        .otherwise(F.col("text"))
    )
    return T.turns(spark, d).withColumn("text", text)


def rounds(spark, d):
    """Each answer in five rounds: narration of a call, the text, the text again, a longer version, a closing section."""
    turns = T.turns(spark, d)
    text = F.col("text")
    parts = F.array(F.lit("I look first <function=grep></function>"), text, text, F.concat(text, F.lit("\nmore")), F.lit("# End"))
    told = turns.filter(F.col("role") == "assistant").select("conv_id", "role", "turn", F.posexplode(parts).alias("k", "text"))
    return turns.filter(F.col("role") != "assistant").select("conv_id", (F.col("turn") * 10).alias("turn"), "role", "text").unionByName(
        told.select("conv_id", (F.col("turn") * 10 + F.col("k")).alias("turn"), "role", "text"))


def dirty_pages(spark, d):
    body = F.concat("body", F.lit("\n" + DRAFT_MARKER + "\n\n\n\n" + JSON_CALL_MARKS[1] + "}\n<function=grep>\nkeep\nantml:" + INVOKE + "\n"))
    return T.docs(spark, d).withColumn("body", body)


def delta_events(spark, d):
    kind = F.when(F.col("event_type") == "signup", "mark").when(F.col("event_type") == "error", "reset").otherwise("delta")
    return T.table(spark, d, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("text"), "ts")


_ROUNDS = """SELECT user_id AS conv, event_id AS seq, props AS text, CASE event_type WHEN 'signup' THEN 'mark' WHEN 'error' THEN 'reset' ELSE 'delta' END AS kind,
    count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS round FROM events"""
_DELTAS = """SELECT conv, seq, text, round, max(round) OVER (PARTITION BY conv) AS last_round, kind, max(CASE WHEN kind = 'reset' THEN seq END) OVER (PARTITION BY conv, round) AS last_reset FROM rounds"""

ENTRIES = {
    "F15_strip_transcripts": (
        lambda s, d: V.strip_transcripts(transcripts(s, d), "conv_id", "turn").select("conv_id", "turn", F.sha2("prose", 256).alias("h")),
        with_views("""SELECT conv_id, turn, sha256(CASE conv_id % 3 WHEN 0 THEN trim(concat(text, chr(10), chr(10), 'END'), chr(32)||chr(9)||chr(10)||chr(13))
            WHEN 1 THEN trim(concat(text, chr(10), 'left over'), chr(32)||chr(9)||chr(10)||chr(13)) ELSE text END) AS h FROM f_conv"""),
    ),
    "F16_extract_calls": (
        lambda s, d: V.extract_calls(transcripts(s, d), "conv_id", "turn", raw_types=("start_line",)).select("conv_id", "turn", "pos", "name", "arguments"),
        with_views("""SELECT conv_id, turn, 0::bigint AS pos, 'read_file' AS name, concat('{"path":"', role, '/a.rs","start_line":', turn, '}') AS arguments FROM f_conv WHERE conv_id % 3 = 0"""),
    ),
    "F17_sanitize_bodies": (
        lambda s, d: V.sanitize(dirty_pages(s, d)),
        with_views("SELECT path, concat(trim(body, chr(32)||chr(9)||chr(10)||chr(13)), chr(10), chr(10), 'keep') AS body FROM f_docs"),
    ),
    "F13_canonical_arguments": (
        lambda s, d: T.tool_log(s, d).select("seq", canonical_arguments(F.concat(
            F.lit('{"z":{"d":[1,"1"],"b":null},"a":'), F.get_json_object("args", "$.k"), F.lit(',"c":"'), F.get_json_object("args", "$.k"), F.lit('"}'))).alias("key")),
        with_views("""SELECT seq, concat('{"a":', json_extract_string(args, '$.k'), ',"c":"', json_extract_string(args, '$.k'), '","z":{"b":null,"d":[1,"1"]}}') AS key FROM f_tools"""),
    ),
    "W20_prose_fold": (
        lambda s, d: V.fold_answers(rounds(s, d)),
        with_views("""SELECT conv_id, answer, concat(ltrim(any_value(text), chr(32)||chr(9)||chr(10)||chr(13)), chr(10), 'more', chr(10), chr(10), '# End') AS body, 5 * count(*) AS n_rounds FROM
            (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM f_conv) WHERE role = 'assistant' GROUP BY conv_id, answer"""),
    ),
    "T3_delta_fold_batch": (
        lambda s, d: V.fold_deltas(delta_events(s, d)),
        with_views("SELECT conv, seq, text FROM deltas WHERE kind = 'delta' AND (last_reset IS NULL OR seq > last_reset)", rounds=_ROUNDS, deltas=_DELTAS),
    ),
}

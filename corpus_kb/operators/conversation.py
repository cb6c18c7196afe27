"""Conversation work: transcripts in text, prose folding, streamed deltas with rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpus_kb.functions import transcripts as X


def strip_transcripts(texts: DataFrame, *keys: str) -> DataFrame:
    """Texts without tool-call transcripts, with the characters removed."""
    cleaned = texts.select(*keys, "text", X.strip_calls(F.col("text")).alias("prose"))
    return cleaned.select(*keys, "prose", (F.length("text") - F.length("prose")).cast("bigint").alias("removed"))


def extract_calls(texts: DataFrame, *keys: str, raw_types: tuple[str, ...] = ()) -> DataFrame:
    """One row per closed function block: ``pos, name, args, arguments``."""
    return texts.filter(F.contains("text", F.lit("<function="))).select(*keys, F.inline(X.tool_calls(F.col("text"), raw_types)))


def sanitize(pages: DataFrame) -> DataFrame:
    return pages.select("path", X.sanitize_body(F.col("body")).alias("body"))


def running_count(rows: DataFrame, key: str, seq: str, test: Column, name: str, block: int = 100_000) -> DataFrame:
    """Rows with the number of rows of their key, up to and including them in ``seq`` order, that pass ``test``.

    Two levels instead of one window per key: rows are numbered inside blocks of ``block`` consecutive
    ``seq`` values, block totals are summed per key, and each block adds what came before it. A key with a
    third of all rows spreads over its blocks.
    """
    flagged = rows.withColumns({"_block": F.floor(F.col(seq) / block), "_hit": F.when(test, 1).otherwise(0).cast("bigint")})
    totals = flagged.groupBy(key, "_block").agg(F.sum("_hit").alias("_hits"))
    before = totals.select(
        key, "_block",
        F.coalesce(
            F.sum("_hits").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = F.sum("_hit").over(W.partitionBy(key, "_block").orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return flagged.withColumn("_inside", inside).join(before, [key, "_block"]).withColumn(
        name, F.col("_before") + F.col("_inside")
    ).drop("_block", "_hit", "_inside", "_before")


def answer_rounds(turns: DataFrame) -> DataFrame:
    """Assistant rounds grouped into answers: everything between two user turns, ``conv_id, answer, rounds``.

    An answer is one generated text, so its rounds are bounded by that text; the conversation around it
    is never gathered.
    """
    numbered = running_count(turns, "conv_id", "turn", F.col("role") == "user", "answer")
    rounds = F.struct("turn", "text", F.col("text").contains("<function=").alias("is_tool_round"))
    return (
        numbered.filter(F.col("role") == "assistant").groupBy("conv_id", "answer")
        .agg(F.array_sort(F.collect_list(rounds)).alias("rounds"))
    )


def fold_answers(turns: DataFrame) -> DataFrame:
    """Page text of each answer: narration and repeats dropped, supersets replace, the rest appended."""
    cleaned = F.transform(
        "rounds", lambda r: F.struct(X.strip_calls(r["text"]).alias("text"), r["is_tool_round"].alias("is_tool_round"))
    )
    return answer_rounds(turns).select(
        "conv_id", "answer", X.merge_prose(cleaned).alias("body"), F.size("rounds").cast("bigint").alias("n_rounds")
    )


def fold_deltas(events: DataFrame, key: str = "conv", seq: str = "seq", committed_only: bool = False) -> DataFrame:
    """Deltas that survive rollback (``kind``: ``delta``, ``mark``, ``reset``): ``key, seq, text``.

    A reset discards what arrived since the last mark. So a delta survives when it comes after the last
    reset of its round; ``committed_only`` keeps rounds that a mark has closed. Survivors stay rows:
    sorted by ``seq`` they are the text.
    """
    rounds = running_count(events, key, seq, F.col("kind") == "mark", "round")
    # a mark opens the next round
    bounds = rounds.groupBy(key, "round").agg(F.max(F.when(F.col("kind") == "reset", F.col(seq))).alias("last_reset"))
    deltas = rounds.filter(F.col("kind") == "delta").join(bounds, [key, "round"])
    kept = deltas.filter(F.col("last_reset").isNull() | (F.col(seq) > F.col("last_reset")))
    if committed_only:
        last = rounds.groupBy(key).agg(F.max("round").alias("last_round"))
        kept = kept.join(last, key).filter(F.col("round") < F.col("last_round"))
    return kept.select(key, seq, "text")

"""Cutting pages into sections and chunks, folding and compacting their lines.

Every operator maps one page row to its result inside that row: no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_kb import schemas
from corpus_kb.functions import markdown as M
from corpus_kb.functions.text import (
    chars_removed, collapse_blank_runs, compact, fold_identical_runs, lines, saved_tokens, strip, trim_line_ends,
)
from corpus_kb.functions.transcripts import model_chunks

# fixed values
MODES = ("structural", "llm-semantic", "hybrid")
DEFAULT_TARGET = 512


def fence_state(pages: DataFrame) -> DataFrame:
    """Numbered lines with a flag for lines inside a fence."""
    return pages.select("path", F.posexplode(M.fence_lines(F.col("body"))).alias("p", "x")).select(
        "path", (F.col("p") + 1).cast("bigint").alias("line_no"), "x.line", "x.in_fence"
    )


def sections(pages: DataFrame, heading_regex: str = "^#") -> DataFrame:
    """Heading sections: ``path, section, title, start_line, end_line, body``."""
    return pages.select("path", F.posexplode(M.sections(F.col("body"), heading_regex)).alias("section", "s")).select(
        "path", F.col("section").cast("bigint").alias("section"), "s.title",
        F.col("s.start_line").cast("bigint").alias("start_line"), F.col("s.end_line").cast("bigint").alias("end_line"),
        F.array_join(F.transform("s.lines", lambda x: x["line"]), "\n").alias("body"),
    )


def fold_runs(pages: DataFrame) -> DataFrame:
    """Pages with their repeated lines folded: ``path, line_no, text, run, saved``."""
    return pages.select("path", F.inline(fold_identical_runs(lines(F.col("body"))))).select(
        "path", F.col("line_no").cast("bigint").alias("line_no"), "text",
        F.col("run").cast("bigint").alias("run"), F.col("saved").cast("bigint").alias("saved"),
    )


def collapse_blanks(pages: DataFrame) -> DataFrame:
    return pages.select("path", collapse_blank_runs(F.col("body")).alias("body"))


def compaction(pages: DataFrame) -> DataFrame:
    """Compacted body with the characters each step removed."""
    trimmed = pages.select("path", "body", trim_line_ends(F.col("body")).alias("t"))
    done = trimmed.select("path", "body", "t", collapse_blank_runs(F.col("t")).alias("compacted"))
    return done.select(
        "path", "compacted",
        (chars_removed(F.col("body"), F.col("t")) + chars_removed(F.col("t"), F.col("compacted"))).cast("bigint").alias("removed"),
    )


def saved_by_compaction(pages: DataFrame) -> DataFrame:
    """One row: pages, characters and tokens saved over the corpus."""
    saved = pages.select(chars_removed(F.col("body"), compact(F.col("body"))).alias("saved"))
    return saved.agg(F.count("*").alias("pages"), F.sum("saved").cast("bigint").alias("saved_chars")).withColumn(
        "saved_tokens", saved_tokens(F.col("saved_chars")).cast("bigint")
    )


def first_headings(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.coalesce(M.first_heading(F.col("body")), F.col("path")).alias("title"))


def claims(pages: DataFrame) -> DataFrame:
    """Bullets of claims sections: ``page_path, ord, statement, evidence, status``."""
    return pages.select(F.col("path").alias("page_path"), F.posexplode(M.claims_of(F.col("body"))).alias("ord", "statement")).select(
        "page_path", F.col("ord").cast("bigint").alias("ord"), "statement",
        F.array(F.concat(F.lit("kb://"), F.col("page_path"))).alias("evidence"), F.lit("active").alias("status"),
    )


def signature(mode: str, target_tokens: int, model: bool) -> str:
    """What decides whether a stored split is current."""
    return f"{mode if mode in MODES else 'hybrid'}|{target_tokens}|llm={'true' if model else 'false'}"


def chunk_id(page_path: Column, ord_: Column, body: Column) -> Column:
    return F.concat(F.lit("ck_"), F.left(F.sha2(F.concat(page_path, ord_.cast("string"), body), 256), F.lit(12)))


def chunk_pages(
    pages: DataFrame, mode: str = "structural", target_tokens: int = DEFAULT_TARGET, answer: str | None = None,
    heading_regex: str = "^#", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Chunk table of a page table (``path, body``).

    ``answer`` names a column with a model's chunking answer; outside structural mode it is used
    where it parses and the structural split elsewhere.
    """
    structural = M.structural_chunks(F.col("body"), target_tokens, heading_regex)
    with_model = mode != "structural" and answer is not None
    cut = pages.select("path", *keep, structural.alias("structural"), *([answer] if with_model else []))
    if with_model:
        parsed = F.when(F.col(answer).isNotNull(), model_chunks(F.col(answer), schemas.MODEL_CHUNKS))
        cut = cut.select(
            "path", *keep, F.when(parsed.isNull(), F.lit("structural")).otherwise(F.lit("llm-semantic")).alias("by"),
            F.when(parsed.isNull(), F.col("structural")).otherwise(M.merge_small(parsed)).alias("items"),
        )
    else:
        cut = cut.select("path", *keep, F.lit("structural").alias("by"), F.col("structural").alias("items"))
    numbered = cut.select(F.col("path").alias("page_path"), *keep, "by", F.posexplode("items").alias("pos", "c"))
    ord_ = F.col("pos").cast("bigint")
    return numbered.select(
        chunk_id(F.col("page_path"), ord_, F.col("c.body")).alias("chunk_id"), "page_path", *keep, ord_.alias("ord"),
        F.col("c.title").alias("title"), F.col("c.summary").alias("summary"), F.col("c.body").alias("body"),
        F.col("c.start_line").cast("bigint").alias("start_line"), F.col("c.end_line").cast("bigint").alias("end_line"),
        F.concat("by", F.lit("|" + signature(mode, target_tokens, with_model))).alias("source"),
    )


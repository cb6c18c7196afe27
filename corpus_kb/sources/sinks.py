"""Sinks: pages, claims sidecars, the index listing, chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_kb.functions.markdown import page_content
from corpus_kb.functions.text import top_dir

ENTRY_PAGE = "quickstart.md"


def page_texts(pages: DataFrame) -> DataFrame:
    """Byte-stable page files ``path, content`` from ``path, title, page_type, description, tags, body``."""
    fields = F.create_map(
        F.lit("type"), F.col("page_type"), F.lit("title"), F.col("title"), F.lit("description"), F.col("description"),
        F.lit("tags"), F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")),
    )
    return pages.select("path", page_content(fields, F.col("body")).alias("content"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Page table sink; the commit protocol makes the write all-or-nothing."""
    page_texts(pages).write.mode("overwrite").parquet(path)


def claims_sidecars(claims: DataFrame) -> DataFrame:
    """One document per claim-bearing page: ``file, page, claims``.

    Claims come from one page's text, so their number per page is bounded by that text.
    """
    return (
        claims.groupBy(F.col("page_path").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("ord", "statement", "evidence", "status"))).alias("c"))
        .select(
            F.concat(F.translate("page", "/\\", "\x01\x01"), F.lit(".json")).alias("f"), "page",
            F.transform("c", lambda x: F.struct(x["statement"].alias("statement"), x["evidence"].alias("evidence"), x["status"].alias("status"))).alias("claims"),
        )
        .select(F.replace("f", F.lit("\x01"), F.lit("__")).alias("file"), "page", "claims")
    )


def write_claims(claims: DataFrame, path: str) -> None:
    claims_sidecars(claims).select("page", "claims").write.mode("overwrite").json(path)


def index_lines(pages: DataFrame) -> DataFrame:
    """The navigation page as ordered rows: ``grp, pos, line``; write them sorted and it is the file.

    Rows instead of one string per folder: a folder with a third of all pages is never collected.
    """
    link = F.concat(F.lit("["), F.col("title"), F.lit("]("), F.col("path"), F.lit(") — "), F.col("description"))
    grouped = pages.select(top_dir(F.col("path")).alias("grp"), "path", link.alias("link"))
    items = grouped.select("grp", F.col("path").alias("pos"), F.concat(F.lit("- "), "link").alias("line"))
    heads = grouped.select("grp").distinct().select("grp", F.lit("").alias("pos"), F.concat(F.lit("## "), "grp").alias("line"))
    entry = grouped.filter(F.col("path") == ENTRY_PAGE).select(
        F.lit("").alias("grp"), F.lit("").alias("pos"), F.concat(F.lit("**Start: "), "link", F.lit("**")).alias("line")
    )
    return entry.unionByName(heads).unionByName(items)


def write_index(pages: DataFrame, path: str) -> None:
    index_lines(pages).repartitionByRange("grp", "pos").sortWithinPartitions("grp", "pos").select("line").write.mode("overwrite").text(path)

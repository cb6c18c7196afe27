"""File readers: listings, guarded text, pages, claims sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_kb import schemas
from corpus_kb.functions.code import SKIP_DIRS, in_skipped_dir, language
from corpus_kb.functions.globs import is_ignored
from corpus_kb.functions.text import basename, escapes_root

# fixed values
SIZE_LIMIT = 2_000_000
MAX_FILE_BYTES = 262_144
SNIFF_BYTES = 1024
README_CHARS = 4000
README_NAMES = ("readme.md", "readme")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; works for any file-system URI."""
    tail = root.rstrip("/").split("://")[-1].lstrip("/")
    return F.regexp_extract(path, r"/\Q" + tail + r"\E/(.*)\z", 1)


def list_files(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """Recursive listing ``repo, rel, language, size``; file contents are never read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    return listed.select(
        F.lit(repo).alias("repo"), relative_path(F.col("path"), root).alias("rel"), F.col("length").alias("size")
    ).select("repo", "rel", language(F.col("rel")).alias("language"), "size")


def keep_source_files(
    files: DataFrame, skip_dirs: list[str] = SKIP_DIRS, rules: Column | None = None, own_files: list[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Files a scan keeps: known language or below 2 MB, no README, not skipped, ignored or written by ourselves."""
    rel = F.col("rel")
    keep = (
        (F.col("language").isNotNull() | (F.col("size") < SIZE_LIMIT))
        & ~F.lower(basename(rel)).isin(*README_NAMES)
        & ~in_skipped_dir(rel, skip_dirs)
    )
    if own_files:
        keep = keep & ~rel.isin(*own_files)
    if rules is not None:
        keep = keep & ~is_ignored(rel, rules)
    kept = files.filter(keep)
    return kept if limit is None else kept.orderBy("rel").limit(limit)


def keep_unignored(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """Apply each repository's own rules (``repo, rules``): an equi-join on the repository, no rule-by-path product."""
    rel = F.col("rel")
    joined = files.join(ignore_files, "repo", "left")
    return joined.filter(F.col("rules").isNull() | ~is_ignored(rel, F.col("rules"))).drop("rules")


def read_texts(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, glob: str | None = None) -> DataFrame:
    """Text files ``rel, text``; too large files are skipped by the file index, files with a NUL byte near the start after it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (
        reader.load(root)
        .filter(F.col("length") <= max_bytes)
        .filter(F.position(F.lit(b"\x00"), F.substring("content", 1, SNIFF_BYTES)) == 0)
        .select(relative_path(F.col("path"), root).alias("rel"), F.decode("content", "UTF-8").alias("text"))
    )


def readme_excerpts(texts: DataFrame) -> DataFrame:
    """One README excerpt per repository: the first by path, 4000 characters."""
    return (
        texts.filter(F.lower(basename(F.col("rel"))).isin(*README_NAMES))
        .select("repo", "rel", F.left("text", F.lit(README_CHARS)).alias("excerpt"))
        .groupBy("repo")
        .agg(F.min_by("excerpt", "rel").alias("excerpt"))
    )


def bounded_excerpt(text: Column, max_chars: int) -> Column:
    return F.left(text, F.lit(max_chars))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Markdown pages ``path, body`` below ``root``; hidden files are no pages."""
    return (
        spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True)
        .text(root, wholetext=True)
        .select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("body"))
        .filter(~F.col("path").startswith("."))
    )


def page_at(pages: DataFrame, path: str) -> DataFrame:
    """Point read; absolute or climbing paths give nothing. The equality reaches the parquet scan."""
    return pages.filter((F.col("path") == path) & ~escapes_root(F.lit(path)))


def read_claims(spark: SparkSession, root: str) -> DataFrame:
    """Claims sidecars below ``root``, one row per claim; unreadable files give nothing."""
    return (
        spark.read.schema(schemas.CLAIMS_SIDECAR).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
        .json(root)
        .filter(F.col("page").isNotNull())
        .select(F.col("page").alias("page_path"), F.inline("claims"))
    )

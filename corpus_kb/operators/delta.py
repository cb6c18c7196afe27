"""Incremental maintenance: upserts, pruning, fingerprints, reuse decisions, reindexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpus_kb.functions import markdown as M
from corpus_kb.functions.text import content_hash, is_blank, mergeable_hash, path_prefixes, strip
from corpus_kb.functions.transcripts import DRAFT_MARKER
from corpus_kb.operators.segment import chunk_pages

# fixed values
TEMPLATE_SUFFIX = "+template"
MIN_BODY_CHARS = 80
STATE_PREFIX = ".corpus_kb/"


def latest(writes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write per key; versions are combined map-side, so a key rewritten very often stays cheap."""
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("v")).select(*keys, *[F.col("v")[c].alias(c) for c in rest])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows after applying ``incoming``: its last write per key, and every untouched existing row.

    Existing rows are only anti-joined on their key; replaying the same batch changes nothing.
    """
    newest = latest(incoming, keys, seq)
    return existing.join(newest.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(newest.select(*existing.columns))


def upsert_claims(existing: DataFrame, incoming: DataFrame, touched: DataFrame) -> DataFrame:
    """Claims keyed by (page_path, statement): new ones added, known ones renewed, those a touched page
    (``page_path``) no longer makes marked ``stale``. All columns of ``existing`` are carried (``evidence, run_id``)."""
    columns = existing.columns
    fresh = latest(incoming, ["page_path", "statement"], "seq").select(*columns)
    kept = existing.join(fresh.select("page_path", "statement"), ["page_path", "statement"], "left_anti")
    pages = touched.select("page_path").distinct().withColumn("touched", F.lit(True))
    retired = kept.join(pages, "page_path", "left").withColumn(
        "status", F.when(F.col("touched"), F.lit("stale")).otherwise(F.col("status"))
    )
    return retired.select(*columns).unionByName(fresh)


def replace_by_page(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunk table after new chunks replaced all chunks of the pages they belong to."""
    pages = incoming.select("page_path").distinct()
    return existing.join(pages, "page_path", "left_anti").unionByName(incoming)


def replace_pages(
    chunks: DataFrame, postings: DataFrame, mentions: DataFrame, incoming: DataFrame, pages: DataFrame, index: Callable[[DataFrame], DataFrame], mention: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, postings and mentions after ``incoming`` chunks replaced everything that belongs to ``pages`` (``page_path``).

    One path for replacing pages, deleting them (no incoming chunks) and appending new ones: rows of the pages' old chunks leave all three
    tables, and only the incoming chunks are indexed (``index``) and searched for names (``mention``).
    """
    # the narrow keys are held by hash, so neither bodies nor postings are sorted for a join
    gone = pages.select("page_path").distinct().hint("shuffle_hash")
    old = chunks.join(gone, "page_path", "left_semi").select("chunk_id").hint("shuffle_hash")
    return (
        chunks.join(gone, "page_path", "left_anti").unionByName(incoming.select(*chunks.columns)),
        postings.join(old, "chunk_id", "left_anti").unionByName(index(incoming).select(*postings.columns)),
        mentions.join(old, "chunk_id", "left_anti").unionByName(mention(incoming).select(*mentions.columns)),
    )


def write_chunks_by_page(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunk sink: overwrite the buckets the chunks fall into. ``chunks`` must hold those buckets in full."""
    placed = chunks.withColumn("page_bucket", F.pmod(F.xxhash64("page_path"), F.lit(buckets)).cast("int"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_bucket").parquet(path)


def vanished(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages whose file is gone."""
    return pages.join(files.select("path").distinct(), "path", "left_anti")


def prune(pages: DataFrame, chunks: DataFrame, postings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, chunks and postings without everything that belongs to vanished pages."""
    kept = pages.join(files.select("path").distinct(), "path", "left_semi")
    gone = vanished(pages, files).select(F.col("path").alias("page_path"))
    kept_chunks = chunks.join(gone, "page_path", "left_anti")
    # gone chunks are few next to all postings: the anti-join side that may be broadcast
    gone_chunks = chunks.join(gone, "page_path", "left_semi").select("chunk_id")
    return kept, kept_chunks, postings.join(gone_chunks, "chunk_id", "left_anti")


def delete_pages(pages: DataFrame, tombstones: DataFrame) -> DataFrame:
    return pages.join(tombstones.select("path").distinct(), "path", "left_anti")


def drop_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Cascade: children whose parent survived."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def reconcile(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Counts of paths in the index and on disk, in the index only, on disk only."""
    a = indexed.select("path").distinct().withColumn("a", F.lit(1))
    b = on_disk.select("path").distinct().withColumn("b", F.lit(1))
    return a.join(b, "path", "full_outer").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"),
        F.count_if(F.col("b").isNull()).alias("index_only"), F.count_if(F.col("a").isNull()).alias("disk_only"),
    )


def scope_of(module: Column) -> Column:
    """Folder a page's evidence comes from: its module where that is a path, else the whole repository (empty)."""
    return F.when(F.contains(module, F.lit("/")) | (module == "src"), F.rtrim(module, F.lit("/"))).otherwise(F.lit(""))


def scope_digests(files: DataFrame) -> DataFrame:
    """Mergeable digest of ``rel:size`` below every folder: ``repo, scope, files, digest``.

    Sums of hashes are combined map-side, in any order, so a folder with a third of all files is never
    collected anywhere.
    """
    row = files.select("repo", "rel", mergeable_hash(F.concat("rel", F.lit(":"), F.col("size").cast("string"))).alias("h"))
    prefixes = F.filter(path_prefixes(F.col("rel")), lambda p: p["is_dir"])
    scopes = F.concat(F.array(F.lit("")), F.transform(prefixes, lambda p: p["prefix"]))
    return row.select("repo", "h", F.explode(scopes).alias("scope")).groupBy("repo", "scope").agg(
        F.count("*").alias("files"), F.sum("h").alias("digest")
    )


def fingerprints(pages: DataFrame, files: DataFrame, salt: str = "") -> DataFrame:
    """Fingerprint per planned page (``repo, path, module, focus, evidence``) over the files in its scope.

    Pages meet the folder digests by equality on (repo, scope).
    """
    scoped = pages.withColumn("scope", scope_of(F.coalesce("module", F.lit(""))))
    joined = scoped.join(scope_digests(files), ["repo", "scope"], "left")
    feed = F.concat_ws(
        "\n", F.lit(salt), F.coalesce("focus", F.lit("")), F.coalesce("evidence", F.lit("")),
        F.coalesce("files", F.lit(0)).cast("string"), F.coalesce(F.col("digest").cast("string"), F.lit("0")),
    )
    return joined.select("repo", "path", F.sha2(feed, 256).alias("fingerprint"))


def usable_body(body: Column) -> Column:
    """Page text without front matter, null for drafts and blank pages."""
    stripped = M.strip_front_matter(body)
    return F.when(~is_blank(stripped) & ~F.contains(stripped, F.lit(DRAFT_MARKER)), stripped)


def reuse_plan(planned: DataFrame, stored: DataFrame, bodies: DataFrame, polluted: Column) -> DataFrame:
    """What to do per planned page (``path, fingerprint``): ``reuse`` its body or ``generate``, and whether a
    failed generation must keep the old body.

    ``stored`` holds ``path, evidence_hash``; ``bodies`` holds ``path, body``; ``polluted`` judges ``body``.
    """
    known = bodies.select("path", usable_body(F.col("body")).alias("body"))
    joined = planned.join(stored.select("path", "evidence_hash"), "path", "left").join(known, "path", "left")
    clean = F.col("body").isNotNull() & ~F.coalesce(polluted, F.lit(False))
    same = F.coalesce(F.col("evidence_hash") == F.col("fingerprint"), F.lit(False))
    template = F.coalesce(F.col("evidence_hash").endswith(TEMPLATE_SUFFIX), F.lit(False))
    return joined.select(
        "path", "fingerprint", F.when(same & clean, F.lit("reuse")).otherwise(F.lit("generate")).alias("action"),
        (clean & ~template).alias("keep_on_failure"),
    )


def outcomes(jobs: DataFrame, polluted: Column) -> DataFrame:
    """Outcome of each page job (``path, action, keep_on_failure, fingerprint, generated, failed``).

    A failed, polluted or too short generation keeps the previous body where there is one to keep and
    becomes a template otherwise; a template's fingerprint never equals a real one.
    """
    bad = F.col("failed") | F.col("generated").isNull() | F.coalesce(polluted, F.lit(False)) | (
        F.length(strip(F.coalesce("generated", F.lit("")))) < MIN_BODY_CHARS
    )
    outcome = (
        F.when(F.col("action") == "reuse", F.lit("reused")).when(~bad, F.lit("generated"))
        .when(F.col("keep_on_failure"), F.lit("kept_previous")).otherwise(F.lit("template"))
    )
    return jobs.select("path", outcome.alias("outcome"), "fingerprint").withColumn(
        "fingerprint", F.when(F.col("outcome") == "template", F.concat("fingerprint", F.lit(TEMPLATE_SUFFIX))).otherwise(F.col("fingerprint"))
    )


def is_no_op(changed: DataFrame, last_head: Column, head: Column) -> DataFrame:
    """One row: whether nothing outside our own outputs changed since the last run (``path`` of changed files)."""
    return changed.agg(F.count_if(~F.col("path").startswith(STATE_PREFIX)).alias("relevant")).select(
        "relevant", ((F.col("relevant") == 0) & (last_head == head)).alias("no_op")
    )


def chunk_currency(pages: DataFrame, stored: DataFrame, chunks: DataFrame, signature: str) -> DataFrame:
    """Pages (``path, body_hash``) whose stored hash is equal and whose chunks all carry the signature."""
    per_page = chunks.groupBy(F.col("page_path").alias("path")).agg(
        F.count("*").alias("n"), F.count_if(F.col("source").endswith("|" + signature)).alias("n_current")
    )
    joined = pages.join(stored.select("path", F.col("body_hash").alias("stored_hash")), "path", "left").join(per_page, "path", "left")
    current = (F.col("body_hash") == F.col("stored_hash")) & (F.col("n") > 0) & (F.col("n") == F.col("n_current"))
    return joined.select("path", F.coalesce(current, F.lit(False)).alias("current"))


def chunk_counts(chunks: DataFrame, signature: str | None = None) -> DataFrame:
    """Chunks per page, all and those with the signature."""
    current = F.count_if(F.col("source").endswith("|" + signature)) if signature else F.count("*")
    return chunks.groupBy("page_path").agg(F.count("*").alias("chunks"), current.alias("current"))


def reindex_pages(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Page table rebuilt from documents (``path, body``), keeping title, type, description and evidence of known pages."""
    usable = documents.filter(~F.contains("body", F.lit(DRAFT_MARKER)) & (F.col("path") != "index.md"))
    prev = known.select("path", F.col("title").alias("t"), F.col("page_type").alias("pt"), F.col("description").alias("d"), F.col("evidence_hash").alias("e"))
    return usable.join(prev, "path", "left").select(
        "path", F.coalesce("t", M.first_heading(F.col("body")), "path").alias("title"),
        F.coalesce("pt", F.lit("Reference")).alias("page_type"), F.coalesce("d", F.lit("")).alias("description"),
        content_hash(F.col("body")).alias("body_hash"), F.coalesce("e", F.lit("")).alias("evidence_hash"),
    )


def reindex_chunks(documents: DataFrame, target_tokens: int = 512) -> DataFrame:
    usable = documents.filter(~F.contains("body", F.lit(DRAFT_MARKER)) & (F.col("path") != "index.md"))
    return chunk_pages(usable, target_tokens=target_tokens)


def patch_text(pages: DataFrame, find: str, replacement: str, everywhere: bool = True) -> DataFrame:
    """Replace a literal in page bodies, everywhere or once, with the number of changes."""
    body, needle = F.col("body"), F.lit(find)
    count = ((F.length(body) - F.length(F.replace(body, needle, F.lit("")))) / len(find)).cast("bigint")
    first = F.concat(
        F.left(body, F.locate(find, body) - 1), F.lit(replacement), F.substring(body, F.locate(find, body) + len(find), F.length(body))
    )
    changed = F.replace(body, needle, F.lit(replacement)) if everywhere else first
    return pages.filter(F.contains(body, needle)).select(
        "path", changed.alias("body"), (count if everywhere else F.lit(1).cast("bigint")).alias("changes")
    )


def patch_lines(pages: DataFrame, start: int, end: int, replacement: str) -> DataFrame:
    """Replace lines ``start..end`` of page bodies; pages that end before ``start`` are left out."""
    body = F.split("body", "\n", -1)
    cut = pages.select("path", body.alias("l")).filter(F.size("l") >= start)
    new = F.concat(F.slice("l", 1, start - 1), F.array(F.lit(replacement)), F.slice("l", end + 1, F.size("l"))) if start > 1 else F.concat(
        F.array(F.lit(replacement)), F.slice("l", end + 1, F.size("l"))
    )
    return cut.select("path", F.array_join(new, "\n").alias("body"), (F.least(F.size("l"), F.lit(end)) - start + 1).cast("bigint").alias("changes"))


def insertion_order(pages: DataFrame) -> DataFrame:
    """Pages in the order they were first inserted (``inserted``)."""
    return pages.orderBy("inserted", "path")


def better_of_two(drafts: DataFrame, revisions: DataFrame) -> DataFrame:
    """Keep the revision of a page where it is clean, long enough and has fewer gaps, or as many and more text.

    Both hold ``path, body, gaps``; revisions also ``polluted``.
    """
    r = revisions.select("path", F.col("body").alias("r_body"), F.col("gaps").alias("r_gaps"), "polluted")
    improved = (
        F.col("r_body").isNotNull() & ~F.col("polluted") & (F.length(strip(F.col("r_body"))) >= MIN_BODY_CHARS)
        & ((F.col("r_gaps") < F.col("gaps")) | ((F.col("r_gaps") == F.col("gaps")) & (F.length("r_body") > F.length("body"))))
    )
    chosen = F.coalesce(improved, F.lit(False))
    return drafts.join(r, "path", "left").select(
        "path", F.when(chosen, F.col("r_body")).otherwise(F.col("body")).alias("body"), chosen.alias("revised")
    )

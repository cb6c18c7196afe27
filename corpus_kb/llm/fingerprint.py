"""Threshold-scaled sketches: every word-shingle hash below a fixed fraction of the hash space is kept (FracMinHash).

A sketch is a plain set, so sketches of parts merge by union, and the share of one document's sketch that another holds estimates
containment however unequal their lengths are. Column functions only.

Rows: null and empty texts have an empty sketch and an empty fingerprint; texts under ``SHINGLE`` words are one shingle; of two empty
sketches the likeness is 1 for equal texts and 0 otherwise. Repeated ids follow each other in the order of their texts; rows with a null id come
first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words a shingle, and one hash in ``SCALE`` is kept.
SHINGLE, SCALE = 5, 4
#: Documents a bucket of the walk in id order, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 4096
_LOWEST = -(1 << 63)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted kept hashes of the text's shingles of five words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    fours = F.zip_with(pairs, F.slice(pairs, 3, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    fives = F.zip_with(fours, F.slice(words, 5, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    hashes = F.when(F.size(words) >= SHINGLE, fives).otherwise(short)
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(_LOWEST + (1 << 64) // scale))))


def fingerprint(kept: Column) -> Column:
    """The sketch as text: ten hexadecimal digits a hash."""
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.hex(F.shiftrightunsigned(h, 24)), 10, "0")), "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Jaccard estimate of two sketches; ``equal`` decides where both are empty."""
    common, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, equal.cast("double")).otherwise(common.cast("double") / (total - common))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has (null for an empty sketch)."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def merge(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row beside the next one in id order (``next_*``), after the last the first; one exchange, no global window.

    Buckets are cut at quantiles of the id. The first rows of a bucket are also sent to the bucket before it, behind its own rows.
    """
    spark = docs.sparkSession
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // bucket_rows))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("q"), F.min("doc_id").alias("m")).first()
    heads = sorted({*(cuts["q"] or []), *([cuts["m"]] if cuts["m"] is not None else [])})
    # null ids sort first: they belong to the first bucket and lead it
    ids = F.lit(heads[1:]).cast("array<bigint>") if len(heads) > 1 else F.array().cast("array<bigint>")
    own = F.aggregate(ids, F.lit(0), lambda a, x: a + F.coalesce((x <= F.col("doc_id")).cast("int"), F.lit(0)))
    m = max(1, len(heads))
    first = F.col("doc_id").isin(heads) | F.col("doc_id").isNull() if heads else F.lit(True)
    before = F.pmod(F.col("bucket") - 1 + F.lit(m), F.lit(m))
    placed = docs.withColumn("bucket", own).withColumn("at", F.explode(F.when(first, F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy")), F.struct(before.cast("int").alias("bucket"), F.lit(1).alias("copy"))))
        .otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))))))
    order = Window.partitionBy("at.bucket").orderBy("at.copy", "doc_id", "text")
    following = F.lead(F.struct(*columns)).over(order)
    return placed.withColumn("next", following).where(F.col("at.copy") == 0).drop("at", "bucket")


def edited(text: Column, chars: Column, following: Column) -> Column:
    """The last quarter (floor) replaced by the first as many code points, or all, of the next text."""
    cut = F.floor(chars / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), chars.cast("int") - cut), F.substring(following, F.lit(1), cut))


def compare(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sketch", sketch(F.col("text"), scale))
    both = with_next(rows, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    changed = both.select("doc_id", "text", "n_chars", "sketch", "next", edited(F.col("text"), F.col("n_chars"), F.col("next.text")).alias("edited"))
    done = changed.withColumn("edited_sketch", sketch(F.col("edited"), scale))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next.sketch"), F.col("text") == F.col("next.text")).alias("near_next"))

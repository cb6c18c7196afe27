"""Text helpers as Column functions.

Everything here stays inside the JVM. A document's lines are handled as an array inside the
document's own row, so line-level work needs no shuffle; only operators that return lines explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
CLIP_CHARS = 400
FOLD_MIN_RUN = 4
ELLIPSIS = "…"
BLANKS = " \t\r\n\f\x0b"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it.

    Without this, an expression referenced inside a higher-order function's lambda can be inlined
    there and evaluated once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def lines(text: Column) -> Column:
    """Lines of a text; ``\\r\\n`` ends a line too and a final line end opens no further line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def join_lines(line_array: Column) -> Column:
    return F.array_join(line_array, "\n")


def clip(line: Column, limit: int = CLIP_CHARS) -> Column:
    return bind(
        strip_end(line),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit(ELLIPSIS))),
    )


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3) + 1


def saved_tokens(chars: Column) -> Column:
    return F.floor(chars / 4)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def top_dir(path: Column) -> Column:
    """First path segment, ``.`` for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("."))


def slug(text: Column) -> Column:
    return F.translate(text, "/\\ :", "----")


def normalize_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, s)),
    )
    return F.array_join(folded, "/")


def escapes_root(path: Column) -> Column:
    """True when a requested path is absolute or climbs with ``..``."""
    return path.startswith("/") | F.array_contains(F.split(path, r"[/\\]"), "..")


def path_prefixes(path: Column) -> Column:
    """Every prefix of a path, the path itself included: ``a``, ``a/b``, ``a/b/c.md``."""
    return bind(
        F.split(path, "/"),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.struct(
                n.alias("depth"),
                F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix"),
                (n < F.size(parts)).alias("is_dir"),
            ),
        ),
    )


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r \t]+(?=\n|\z)", "")


def _run_starts(items: Column) -> Column:
    """Indexes at which an element differs from its predecessor."""
    return F.filter(
        F.sequence(F.lit(0), F.size(items) - 1),
        lambda i: (i == 0) | (F.get(items, i) != F.get(items, i - 1)),
    )


def runs(items: Column) -> Column:
    """Runs of equal neighbours: ``array<struct<start, n, item>>``, one pass."""
    empty = F.array().cast("array<struct<start:int,n:int,item:string>>")
    built = bind(
        items,
        lambda a: bind(
            _run_starts(a),
            lambda starts: F.transform(
                starts,
                lambda s, k: F.struct(
                    s.alias("start"),
                    (F.coalesce(F.get(starts, k + 1), F.size(a)) - s).alias("n"),
                    F.get(a, s).alias("item"),
                ),
            ),
        ),
    )
    return F.when(F.size(items) > 0, built).otherwise(empty)


def fold_identical_runs(line_array: Column) -> Column:
    """Fold each run of equal non-blank lines into its first line plus ``  (xN)``.

    Kept lines keep their original numbers: ``array<struct<line_no, text, run, saved>>``.
    """

    def fold(run: Column) -> Column:
        marker = F.concat(F.lit("  (x"), run["n"].cast("string"), F.lit(")"))
        gain = (run["n"] - 1) * (F.length(run["item"]) + 1) - F.length(marker)
        folded = F.array(
            F.struct(
                (run["start"] + 1).alias("line_no"), F.concat(run["item"], marker).alias("text"),
                run["n"].alias("run"), gain.alias("saved"),
            )
        )
        kept = F.transform(
            F.sequence(F.lit(1), run["n"]),
            lambda j: F.struct(
                (run["start"] + j).alias("line_no"), run["item"].alias("text"),
                F.lit(1).alias("run"), F.lit(0).alias("saved"),
            ),
        )
        return F.when((run["n"] >= FOLD_MIN_RUN) & ~is_blank(run["item"]) & (gain > 0), folded).otherwise(kept)

    return F.flatten(F.transform(runs(line_array), fold))


def unfold_runs(folded: Column) -> Column:
    """Inverse of :func:`fold_identical_runs`: the original line array."""
    return F.flatten(
        F.transform(
            folded,
            lambda r: F.when(
                r["run"] > 1,
                F.array_repeat(
                    F.left(r["text"], F.length(r["text"]) - F.length(F.concat(F.lit("  (x"), r["run"].cast("string"), F.lit(")")))),
                    r["run"],
                ),
            ).otherwise(F.array(r["text"])),
        )
    )


def collapse_blank_runs(text: Column) -> Column:
    """Keep one blank line of each run, none at the start or end."""
    collapsed = bind(
        F.split(text, "\n", -1),
        lambda a: F.filter(a, lambda l, i: ~is_blank(l) | ((i > 0) & ~is_blank(F.coalesce(F.get(a, i - 1), F.lit(""))))),
    )
    joined = F.array_join(F.transform(collapsed, lambda l: F.when(is_blank(l), F.lit("")).otherwise(l)), "\n")
    return F.btrim(joined, F.lit("\n"))


def compact(text: Column) -> Column:
    return collapse_blank_runs(trim_line_ends(text))


def chars_removed(before: Column, after: Column) -> Column:
    return F.greatest(F.length(before) - F.length(after), F.lit(0))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def mergeable_hash(text: Column) -> Column:
    """48 hash bits as a number; summed over rows it fingerprints a multiset in any order."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(12)), 16, 10).cast("decimal(20,0)")

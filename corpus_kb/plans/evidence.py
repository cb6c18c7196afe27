"""Evidence bundle of each planned page: repository header, page list, files and outline in scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpus_kb.functions import code
from corpus_kb.functions.text import path_prefixes
from corpus_kb.operators.delta import scope_of
from corpus_kb.operators.outline import manifest_entries, outline_line
from corpus_kb.operators.scan import corpus_facts, detect_modules, files_per_hint

# budget of one bundle, passed by the caller
BUDGET = {"listed_files": 60, "listed_pages": 12, "readme_chars": 900, "outlined_files": 14, "outline_chars": 4200, "items_per_file": 8, "modules": 12, "manifests": 12, "manifest_names": 30}
MORE_FILES = "- and more\n"


def _top(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """First ``limit`` rows per group; the limit is applied in every map task before the shuffle."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("pos") <= limit)


def _lines(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Ordered lines of a group that is already limited, joined to one text."""
    listed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return listed.select(*group, F.array_join(F.transform("x", lambda e: e["line"]), "").alias(name))


def manifest_lines(manifests: DataFrame, limit: int, names: int) -> DataFrame:
    """``repo, manifests``: a line for each of a repository's first ``limit`` manifests by path, with up to ``names`` names of each kind it declares.

    ``manifests`` holds ``repo, rel, text``. Paths are ranked without their texts; names are cut by rank, so a long manifest is not gathered whole.
    """
    top = _top(manifests.select("repo", "rel"), ["repo"], ["rel"], limit)
    declared = manifest_entries(manifests.join(top.select("repo", "rel"), ["repo", "rel"], "left_semi").select("rel", "text"))
    ranked = declared.withColumn("at", F.row_number().over(W.partitionBy("rel", "kind").orderBy("name"))).filter(F.col("at") <= names + 1)
    shown = F.when(F.col("at") > names, F.lit("…")).otherwise(F.col("name"))
    kinds = ranked.groupBy("rel", "kind").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("name")))).alias("x")).select(
        "rel", F.concat(F.lit(" · "), "kind", F.lit(": "), F.array_join(F.transform("x", lambda e: e["name"]), ", ")).alias("part"))
    parts = kinds.groupBy("rel").agg(F.array_join(F.array_sort(F.collect_list("part")), "").alias("parts"))
    lines = top.join(parts, "rel", "left").select("repo", "pos", F.concat(F.lit("- `"), "rel", F.lit("`"), F.coalesce("parts", F.lit("")), F.lit("\n")).alias("line"))
    return _lines(lines, ["repo"], "manifests")


def headers(files: DataFrame, readmes: DataFrame, modules: int, readme_chars: int, manifests: DataFrame | None = None) -> DataFrame:
    """One header per repository (``repo, header``): facts, README excerpt, manifests (:func:`manifest_lines`), modules with their file counts."""
    detected = detect_modules(files, modules)
    counted = detected.join(files_per_hint(detected.select("repo", "hint"), files), ["repo", "hint"])
    line = F.concat(
        F.lit("- "), "label", F.lit(" (`"), "key", F.lit("` → `"), "hint", F.lit("`) · "), F.col("source_files").cast("string"), F.lit(" files\n")
    )
    listed = _lines(counted.select("repo", F.col("key").alias("pos"), line.alias("line")), ["repo"], "modules")
    facts = corpus_facts(files)
    excerpt = F.when(F.col("excerpt").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("\n# From the readme\n"), F.left("excerpt", F.lit(readme_chars)), F.lit("\n"))
    )
    joined = facts.join(readmes, "repo", "left").join(listed, "repo", "left")
    if manifests is None:
        declared = F.lit("")
    else:
        joined = joined.join(manifests, "repo", "left")
        declared = F.concat(F.lit("\n# Manifests\n"), F.coalesce("manifests", F.lit("- none\n")))
    return joined.select(
        "repo",
        F.concat(
            F.lit("Sources: "), F.col("source_files").cast("string"), F.lit("; written in "),
            F.when(F.col("languages") == "", F.lit("unknown")).otherwise(F.col("languages")), F.lit("\n"), excerpt, declared,
            F.lit("\n# Modules\n"), F.coalesce("modules", F.lit("")),
        ).alias("header"),
    )


def page_lists(plan: DataFrame, limit: int) -> DataFrame:
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(") — "), "description", F.lit("\n"))
    top = _top(plan.select("repo", "path", line.alias("line")), ["repo"], ["path"], limit)
    return _lines(top, ["repo"], "page_list")


def _scoped(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Source files once per wanted (repo, scope) they lie in; unwanted folders drop out before any ranking."""
    prefixes = F.filter(path_prefixes(F.col("rel")), lambda p: p["is_dir"])
    every = F.concat(F.array(F.lit("")), F.transform(prefixes, lambda p: p["prefix"]))
    return (
        files.filter(F.col("language").isNotNull()).withColumn("scope", F.explode(every))
        .join(scopes, ["repo", "scope"], "left_semi")
    )


def evidence(plan: DataFrame, texts: DataFrame, readmes: DataFrame, budget: dict[str, int], manifests: DataFrame | None = None) -> DataFrame:
    """Evidence text per page. ``plan``: ``repo, path, title, description, module``; ``texts``: files with their text; ``manifests``: ``repo, rel, text``.

    ``budget`` bounds each list (see ``BUDGET``). Lists are limited per (repository, scope) before they are joined to text, so the size of a folder
    never matters; pages meet their scope by equality.
    """
    files = texts.select("repo", "rel", "language", "size")
    scoped_plan = plan.withColumn("scope", scope_of(F.coalesce("module", F.lit(""))))
    scopes = scoped_plan.select("repo", "scope").distinct()

    listed = _top(_scoped(files, scopes), ["repo", "scope"], ["rel"], budget["listed_files"] + 1)
    file_line = F.when(F.col("pos") > budget["listed_files"], F.lit(MORE_FILES)).otherwise(
        F.concat(F.lit("- "), "rel", F.lit(" ("), "language", F.lit(", "), F.col("size").cast("string"), F.lit(" B)\n"))
    )
    file_lists = _lines(listed.select("repo", "scope", "pos", file_line.alias("line")), ["repo", "scope"], "file_list")

    # rank on metadata only, then fetch the texts of the few chosen files
    largest = _top(_scoped(files, scopes), ["repo", "scope"], [F.desc("size"), "rel"], budget["outlined_files"])
    wanted = texts.select("repo", "rel", "text").join(largest, ["repo", "rel"])
    lines = wanted.select(
        "repo", "scope", "pos",
        outline_line(F.col("rel"), F.col("language"), F.col("size"), code.outline(F.col("text"), F.col("language")), budget["items_per_file"]).alias("line"),
    )
    used = F.coalesce(
        F.sum(F.length("line")).over(W.partitionBy("repo", "scope").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    outlines = _lines(lines.withColumn("used", used).filter(F.col("used") <= budget["outline_chars"]), ["repo", "scope"], "outline")

    declared = None if manifests is None else manifest_lines(manifests, budget["manifests"], budget["manifest_names"])
    joined = (
        scoped_plan.join(headers(files, readmes, budget["modules"], budget["readme_chars"], declared), "repo", "left").join(page_lists(plan, budget["listed_pages"]), "repo", "left")
        .join(file_lists, ["repo", "scope"], "left").join(outlines, ["repo", "scope"], "left")
    )
    scope_name = F.when(F.col("scope") == "", F.lit("repository")).otherwise(F.lit("module"))
    return joined.select(
        "repo", "path",
        F.concat(
            F.coalesce("header", F.lit("")), F.lit("\n# Planned pages\n"), F.coalesce("page_list", F.lit("")),
            F.lit("\n# Files of the "), scope_name, F.lit("\n"), F.coalesce("file_list", F.lit("")),
            F.lit("\n# Declarations by line\n"), F.coalesce("outline", F.lit("- none\n")),
        ).alias("evidence"),
    )

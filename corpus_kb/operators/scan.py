"""Operators over file and path tables: filters, listings, module detection, path rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpus_kb.functions.code import API_FILES, CI_HINTS, DATA_MODEL_HINTS, ENTRY_NAMES, MANIFESTS, has_hint
from corpus_kb.functions.globs import matches_any, matches_glob
from corpus_kb.functions.text import basename, lines, path_prefixes, top_dir

# fixed values: folders that hold one package each in a multi-package repository
PACKAGE_ROOTS = "crates packages apps services libs modules components pkg cmd internal".split()
# fixed values: folders that are no module
NO_MODULE_DIRS = (
    "node_modules target dist build vendor out coverage .git .github .idea .vscode .venv venv __pycache__ docs doc "
    "corpus_kb_out test tests testdata fixtures"
).split()
PACKAGE_FILES = r"(?:Cargo\.toml|package\.json|pyproject\.toml|go\.mod|pom\.xml|build\.gradle|CMakeLists\.txt)\z"
TODO_MARKS = ("TODO", "FIXME", "XXX")


def glob_files(files: DataFrame, glob: str | None = None, redact: list[str] = (), limit: int | None = None) -> DataFrame:
    """Files that match a glob and no privacy pattern, in path order."""
    rel = F.col("rel")
    kept = files.filter(~matches_any(rel, list(redact)))
    if glob:
        kept = kept.filter(matches_glob(rel, glob))
    return kept.orderBy("rel") if limit is None else kept.orderBy("rel").limit(limit)


def in_scope(files: DataFrame, module: str | None) -> DataFrame:
    """Source files below a module; the prefix test is pushed to the scan. No module means all."""
    sources = files.filter(F.col("language").isNotNull())
    if module is None or not ("/" in module or module == "src"):
        return sources
    return sources.filter(F.col("rel").startswith(module.rstrip("/") + "/"))


def entry_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    found = files.filter(F.col("language").isNotNull() & basename(F.col("rel")).isin(*ENTRY_NAMES))
    return found if limit is None else found.orderBy("rel").limit(limit)


def file_hints(files: DataFrame) -> DataFrame:
    """Which files hold data models, automation, API surfaces or manifests."""
    rel = F.col("rel")
    return files.select(
        "rel", has_hint(rel, DATA_MODEL_HINTS).alias("data_model"), has_hint(rel, CI_HINTS).alias("automation"),
        basename(rel).isin(*API_FILES).alias("api"), F.lower(basename(rel)).isin(*MANIFESTS).alias("manifest"),
    )


def files_per_top_dir(files: DataFrame) -> DataFrame:
    return (
        files.filter(F.col("language").isNotNull()).groupBy(top_dir(F.col("rel")).alias("dir"))
        .agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir")
    )


def corpus_facts(files: DataFrame) -> DataFrame:
    """Per repository: files, source files, languages (a set bounded by the language table)."""
    return files.groupBy("repo").agg(
        F.count("*").alias("files"), F.count("language").alias("source_files"),
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"),
    )


def _module_candidates() -> Column:
    rel, is_source = F.col("rel"), F.col("language").isNotNull()
    parts = F.split(rel, "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    nested = F.size(parts) > 1
    named = lambda c: (c != "") & ~c.isin(*NO_MODULE_DIRS)

    def candidate(test: Column, tier: Column, key: Column, label: Column, hint: Column) -> Column:
        return F.when(
            test, F.struct(tier.cast("int").alias("tier"), key.alias("key"), label.alias("name"), hint.alias("hint"))
        )

    root_tier = F.array_position(F.array(*[F.lit(r) for r in PACKAGE_ROOTS]), first)
    package = candidate(
        (root_tier > 0) & nested & named(second) & (is_source | rel.rlike(PACKAGE_FILES)),
        root_tier, F.concat(first, F.lit("/"), second), second, F.concat(first, F.lit("/"), second, F.lit("/")),
    )
    in_src = is_source & nested & (first == "src")
    src_file = candidate(in_src & (F.size(parts) == 2), F.lit(50), F.lit("src/src"), F.lit("src"), F.lit("src/"))
    src_dir = candidate(
        in_src & (F.size(parts) > 2) & named(second), F.lit(50), F.concat(F.lit("src/"), second), second,
        F.concat(F.lit("src/"), second, F.lit("/")),
    )
    top = candidate(is_source & named(first), F.lit(60), first, first, F.concat(first, F.lit("/")))
    root = candidate(is_source & ~nested, F.lit(70), F.lit("root"), F.lit("根目录源码"), F.lit("./"))
    return F.array_compact(F.array(package, src_file, src_dir, top, root))


def detect_modules(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Modules per repository from the first layout that yields any: package roots, ``src/*``, top folders, root files.

    Each file offers candidates of several tiers; counts are pre-aggregated per (repo, tier, key) and
    only the lowest tier of a repository is kept.
    """
    offered = files.select("repo", "language", F.inline(_module_candidates()))
    counted = offered.groupBy("repo", "tier", "key", "name", "hint").agg(
        F.count("*").alias("files"), F.array_sort(F.collect_set("language")).alias("languages")
    )
    best = counted.groupBy("repo").agg(F.min("tier").alias("tier"))
    kept = counted.join(best, ["repo", "tier"])
    ranked = kept if limit is None else kept.withColumn("pos", F.row_number().over(W.partitionBy("repo").orderBy("key"))).filter(F.col("pos") <= limit)
    label = F.when(
        (F.col("tier") < 50) & (F.size("languages") > 0),
        F.concat("name", F.lit(" ["), F.array_join(F.slice("languages", 1, 3), "/"), F.lit("]")),
    ).otherwise(F.col("name"))
    return ranked.select("repo", "key", label.alias("label"), "hint", "files")


def largest_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Source files by size, largest first and ties by path: ``rel, size``; with a limit each task keeps its own first rows only."""
    order = files.filter(F.col("language").isNotNull()).select("rel", "size")
    return order if limit is None else order.orderBy(F.desc("size"), "rel").limit(limit)


def module_representatives(files: DataFrame) -> DataFrame:
    """First file of each top folder that holds code of the main languages."""
    top = F.split_part("rel", F.lit("/"), F.lit(1))
    return (
        files.filter(F.col("language").isin("rust", "typescript", "python"))
        .select("repo", top.alias("module"), "rel").filter(~F.col("module").isin("docs", "web"))
        .groupBy("repo", "module").agg(F.min("rel").alias("path"))
    )


def todo_hotspots(texts: DataFrame, limit: int | None = None, marks: tuple[str, ...] = TODO_MARKS) -> DataFrame:
    """Files with the most marked lines; counted inside each file's row, so only counts reach the sort."""
    counted = texts.select("rel", F.size(F.filter(lines(F.col("text")), lambda l: l.rlike("|".join(marks)))).cast("bigint").alias("hits"))
    found = counted.filter(F.col("hits") > 0)
    return found if limit is None else found.orderBy(F.desc("hits"), "rel").limit(limit)


def path_tree(paths: DataFrame, column: str = "path") -> DataFrame:
    """Every path prefix with the number of files beneath it; map-side combine collapses hot folders."""
    return (
        paths.select(F.inline(path_prefixes(F.col(column))))
        .groupBy("prefix", "depth", "is_dir").agg(F.count("*").alias("files"))
        .select("prefix", F.col("depth").cast("bigint").alias("depth"), "is_dir", "files")
    )


def list_tree(paths: DataFrame, below: str = "", depth: int = 2, limit: int | None = None, column: str = "path") -> DataFrame:
    """Folder listing below a path, folders first, down to ``depth`` levels."""
    base = below.strip("/")
    scoped = paths.filter(F.col(column).startswith(base + "/")) if base else paths
    start = len(base.split("/")) if base else 0
    nodes = path_tree(scoped, column).filter((F.col("depth") > start) & (F.col("depth") <= start + depth))
    return nodes if limit is None else nodes.orderBy(F.desc("is_dir"), "prefix").limit(limit)


def capped_lists(pairs: DataFrame, owner: str, item: str, limit: int) -> DataFrame:
    """Sorted, deduplicated, capped list of each owner's items, ``, …`` when there are more.

    Duplicates go first (map-side), then at most ``limit + 1`` items per owner leave each map task.
    """
    ranked = pairs.select(owner, item).distinct().withColumn("pos", F.row_number().over(W.partitionBy(owner).orderBy(item)))
    kept = ranked.filter(F.col("pos") <= limit + 1).groupBy(owner).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return kept.select(
        owner,
        F.concat(
            F.array_join(F.slice("items", 1, limit), ", "), F.when(F.size("items") > limit, F.lit(", …")).otherwise(F.lit(""))
        ).alias("listed"),
    )


def kinds(entities: DataFrame) -> DataFrame:
    return entities.select("kind").distinct()


def files_per_hint(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Source files below each module's path hint.

    Files are counted per folder prefix first; the hints then meet those counts by equality.
    """
    prefixes = (
        files.filter(F.col("language").isNotNull())
        .select("repo", F.inline(path_prefixes(F.col("rel")))).filter("is_dir")
        .groupBy("repo", F.concat("prefix", F.lit("/")).alias("hint")).agg(F.count("*").alias("source_files"))
    )
    return modules.join(prefixes, ["repo", "hint"], "left").select(
        "repo", "hint", F.coalesce("source_files", F.lit(0)).alias("source_files")
    )

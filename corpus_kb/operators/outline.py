"""Declarations, symbols and manifest contents of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpus_kb.functions import code
from corpus_kb.functions.globs import matches_any, matches_glob
from corpus_kb.functions.text import basename, bind, clip, lines, strip


def numbered_lines(texts: DataFrame, key: str = "rel") -> DataFrame:
    """One row per line; the explode stays in the task that read the file."""
    return texts.select(key, F.posexplode(lines(F.col("text"))).alias("p", "line")).select(
        key, (F.col("p") + 1).cast("bigint").alias("line_no"), "line"
    )


def searchable(texts: DataFrame, key: str = "rel", glob: str | None = None, redact: list[str] = (), max_bytes: int | None = None) -> DataFrame:
    """Text files that a search may show: no skipped folder, no redacted path, within the glob and the size guard."""
    path = F.col(key)
    keep = code.is_text_extension(path) & ~code.in_skipped_dir(path)
    if redact:
        keep = keep & ~matches_any(path, list(redact))
    if glob:
        keep = keep & matches_glob(path, glob)
    if max_bytes is not None:
        keep = keep & (F.octet_length("text") <= max_bytes)
    return texts.filter(keep)


def grep(
    texts: DataFrame, pattern: str, glob: str | None = None, limit: int | None = None, key: str = "rel", redact: list[str] = (), max_bytes: int | None = None,
) -> DataFrame:
    """Lines that contain a literal, ignoring case, as they are but for their end; files without it are dropped before their lines are split."""
    wanted = searchable(texts, key, glob, redact, max_bytes).filter(F.contains(F.lower("text"), F.lit(pattern.lower())))
    hits = (
        numbered_lines(wanted, key).filter(F.contains(F.lower("line"), F.lit(pattern.lower())))
        .select(key, "line_no", clip(F.col("line")).alias("line"))
    )
    return hits if limit is None else hits.orderBy(key, "line_no").limit(limit)


def find_definitions(
    texts: DataFrame, name: str, limit: int | None = None, prefix: bool = False, glob: str | None = None, redact: list[str] = (), max_bytes: int | None = None,
) -> DataFrame:
    """Lines that define a symbol in any of the common languages; where the files carry a repository, so do the hits."""
    keys = [c for c in ("repo", "rel") if c in texts.columns]
    wanted = searchable(texts, "rel", glob, redact, max_bytes).filter(F.contains("text", F.lit(name)))
    lined = wanted.select(*keys, F.posexplode(lines(F.col("text"))).alias("p", "line"))
    hits = (
        lined.filter(code.defines(F.col("line"), name, prefix))
        .select(*keys, (F.col("p") + 1).cast("bigint").alias("line_no"), clip(strip(F.col("line"))).alias("line"))
    )
    return hits if limit is None else hits.orderBy(*keys, "line_no").limit(limit)


def read_window(texts: DataFrame, path: str, start: int = 1, end: int | None = None, size: int = 120) -> DataFrame:
    """Lines ``start..end`` of one file with the total and where to continue; no rows when out of range."""
    last = end if end is not None else start + size - 1
    cut = texts.filter(F.col("rel") == path).select("rel", lines(F.col("text")).alias("l")).select(
        "rel", F.size("l").cast("bigint").alias("total"),
        F.posexplode(F.slice("l", start, max(last - start + 1, 0))).alias("p", "line"),
    )
    return cut.select(
        "rel", (F.col("p") + start).cast("bigint").alias("line_no"), clip(F.col("line")).alias("line"), "total",
        F.when(F.col("total") > last, F.lit(last + 1).cast("bigint")).alias("next_start"),
    )


def outline(texts: DataFrame, max_items: int | None = None) -> DataFrame:
    """One row per declaration: ``repo, rel, line, kind, name``."""
    return texts.filter(F.col("language").isNotNull()).select(
        "repo", "rel", F.inline(code.outline(F.col("text"), F.col("language"), max_items))
    )


def symbol_table(texts: DataFrame) -> DataFrame:
    """Public symbols of each file: ``repo, rel, kind, name``."""
    return texts.filter(F.col("language").isNotNull()).select(
        "repo", "rel", F.inline(code.symbols(F.col("text"), F.col("language")))
    )


def outline_line(rel: Column, language: Column, size: Column, items: Column, max_items: int | None = None) -> Column:
    head = F.concat(F.lit("- `"), rel, F.lit("` ("), language)
    decls = F.transform(
        items if max_items is None else F.slice(items, 1, max_items),
        lambda d: F.concat(F.lit("`"), d["line"].cast("string"), F.lit("` "), d["kind"], F.lit(" "), d["name"]),
    )
    return F.when(F.size(items) == 0, F.concat(head, F.lit(")\n"))).otherwise(
        F.concat(head, F.lit(", "), size.cast("string"), F.lit(" B): "), F.array_join(decls, " · "), F.lit("\n"))
    )


def outline_summary(texts: DataFrame, max_files: int, max_chars: int, max_items: int | None = None) -> DataFrame:
    """Outline lines of each repository's largest files within a character budget.

    Each file becomes one short line in its own task; only those lines are ranked, and at most
    ``max_files`` per repository leave a map task.
    """
    short = texts.filter(F.col("language").isNotNull()).select(
        "repo", "rel", "size",
        outline_line(F.col("rel"), F.col("language"), F.col("size"), code.outline(F.col("text"), F.col("language")), max_items).alias("line"),
    )
    ranked = short.withColumn("pos", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("size"), "rel"))).filter(
        F.col("pos") <= max_files
    )
    before = F.coalesce(
        F.sum(F.length("line")).over(W.partitionBy("repo").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return ranked.withColumn("used", before).filter(F.col("used") <= max_chars).select("repo", F.col("pos").cast("bigint").alias("pos"), "rel", "line")


def _quoted(text: Column) -> Column:
    return F.filter(F.split(text, '"', -1), lambda s, i: (i % 2 == 1) & (s != ""))


def _toml_sections(text: Column) -> Column:
    """``array<struct<section, body>>``: the text split at its section lines."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=[^\S\n]*\[[^\n\]]*\][^\S\n]*(?:\r?\n|\z))", -1)
    return F.transform(
        parts,
        lambda p, k: F.struct(
            F.when(k == 0, F.lit("")).otherwise(strip(F.regexp_extract(p, r"\[([^\n\]]*)\]", 1))).alias("section"),
            F.when(k == 0, p).otherwise(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("body"),
        ),
    )


def _keys(body: Column) -> Column:
    pairs = F.filter(F.transform(lines(body), lambda l: strip(l)), lambda l: F.contains(l, F.lit("=")))
    return F.filter(
        F.transform(pairs, lambda l: F.btrim(strip(F.split_part(l, F.lit("="), F.lit(1))), F.lit('"'))),
        lambda k: (k != "") & ~k.startswith("#"),
    )


def _entries(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def _cargo(text: Column) -> Column:
    def of(sections: Column) -> Column:
        deps = F.flatten(F.transform(F.filter(sections, lambda s: F.contains(s["section"], F.lit("dependencies"))), lambda s: _keys(s["body"])))
        package = F.transform(
            F.filter(sections, lambda s: s["section"] == "package"),
            lambda s: F.regexp_extract(s["body"], r'(?m)^\s*name\s*=\s*"?([^"\n]*?)"?\s*$', 1),
        )
        members = F.flatten(
            F.transform(
                F.filter(sections, lambda s: s["section"] == "workspace"),
                lambda s: _quoted(F.regexp_extract(s["body"], r"(?m)^\s*members([^\]]*)", 1)),
            )
        )
        return F.concat(_entries("package", F.filter(package, lambda n: n != "")), _entries("member", members), _entries("dep", deps))

    return bind(_toml_sections(text), of)


def _pyproject(text: Column) -> Column:
    listed = _quoted(F.regexp_extract(text, r"(?m)^\s*dependencies([^\]]*)", 1))
    tables = F.flatten(
        F.transform(
            F.filter(_toml_sections(text), lambda s: s["section"].endswith("dependencies")), lambda s: _keys(s["body"])
        )
    )
    return _entries("dep", F.concat(listed, tables))


def _go(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^\s*require \(([^)]*)"), F.lit(1))
    listed = F.flatten(F.transform(blocks, lambda b: F.transform(lines(b), lambda l: strip(l))))
    names = F.transform(F.filter(listed, lambda l: l != ""), lambda l: F.split(l, r"\s+")[0])
    return _entries("dep", names)


def _package_json(text: Column) -> Column:
    def keys(section: str) -> Column:
        found = F.json_object_keys(F.get_json_object(text, f"$.{section}"))
        return F.coalesce(found, F.array().cast("array<string>"))

    name = F.get_json_object(text, "$.name")
    return F.concat(
        _entries("package", F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))),
        _entries("script", keys("scripts")), _entries("dep", keys("dependencies")), _entries("dev_dep", keys("devDependencies")),
    )


def manifest_entries(texts: DataFrame) -> DataFrame:
    """Packages, workspace members, scripts and dependencies declared in manifests: ``rel, kind, name``."""
    base, text = basename(F.col("rel")), F.col("text")
    parsed = (
        F.when(base == "Cargo.toml", _cargo(text)).when(base == "package.json", _package_json(text))
        .when(base == "go.mod", _go(text)).when(base == "pyproject.toml", _pyproject(text))
    )
    return (
        texts.filter(base.isin("Cargo.toml", "package.json", "go.mod", "pyproject.toml"))
        .select("rel", F.inline(parsed)).distinct()
    )

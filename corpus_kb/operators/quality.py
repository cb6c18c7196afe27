"""Quality gates: pollution, placeholders, depth features, links, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_kb.functions import markdown as M
from corpus_kb.functions.text import bind, lines, strip, strip_start
from corpus_kb.functions.transcripts import DRAFT_MARKER, INVOKE, JSON_CALL_MARKS
from corpus_kb.operators.graph import page_links

# fixed values: text that marks a body as a tool transcript, checked in this order
POLLUTION_MARKERS = (
    DRAFT_MARKER, "<function=", "<function_calls", "</function", "antml:", "<tool_call", "</tool_call", "<parameter=",
    "</parameter", "<tool_use", f"<{INVOKE} name=", "tool_use_id", "assistant to=functions", *JSON_CALL_MARKS, "corpus_kb:draft",
)
TRANSCRIPT_LINES = "<function* transcript lines"

# fixed values: phrases that stand for missing content
PLACEHOLDERS = "需人工补全 由人工补充 人工补充 待补充 待完善 此处省略 省略若干 （略） TBD 见代码 （待确认） 待确认".split()

# fixed values: bars of the depth check
MIN_CHARS, MIN_CHARS_SHORT = 1200, 1000
SHORT_TYPES = ("Quickstart", "Onboarding")
DIAGRAM_TYPES = ("Architecture", "Data Model", "Workflow", "Module")
MIN_SECTIONS, MIN_SECTIONS_MODULE = 4, 5
MIN_CITATIONS, MIN_TABLE_LINES, MIN_CLAIMS = 8, 3, 5
MERMAID = "```mermaid"
REQUIRED_PAGES = ("quickstart.md", "README.md", "index.md")
ENTRY_MIN_CHARS = 120


def first_marker(text: Column, markers: tuple[str, ...] | list[str]) -> Column:
    """First of the given markers, in list order, that occurs in a text."""
    out = None
    for m in markers:
        test = F.contains(text, F.lit(m))
        out = F.when(test, F.lit(m)) if out is None else out.when(test, F.lit(m))
    return out


def pollution(body: Column, markers: tuple[str, ...] = POLLUTION_MARKERS) -> Column:
    """First transcript marker of a body without its front matter, null for a clean one."""

    def of(text: Column) -> Column:
        call_lines = F.size(F.filter(lines(text), lambda l: strip(l).rlike(r"\A(?:<function|antml:function)")))
        return F.coalesce(first_marker(text, markers), F.when(call_lines >= 2, F.lit(TRANSCRIPT_LINES)))

    return bind(M.strip_front_matter(body), of)


def depth_features(pages: DataFrame, keep: tuple[str, ...] = ("page_type",)) -> DataFrame:
    """Countable features of each page, all inside its own row."""
    body = F.col("body")

    def count(test) -> Column:
        return F.size(F.filter("_lines", test)).cast("bigint")

    is_claims_head = lambda l: strip_start(l).startswith("#") & F.contains(l, F.lit("Claims"))
    prepared = pages.select("path", *keep, "body", lines(body).alias("_lines"))
    head = F.get(F.filter(F.sequence(F.lit(0), F.size("_lines")), lambda i: F.coalesce(is_claims_head(F.get("_lines", i)), F.lit(False))), F.lit(0))
    return prepared.withColumn("_head", head).select(
        "path", *keep,
        F.length(body).cast("bigint").alias("chars"),
        count(lambda l: strip_start(l).startswith("## ")).alias("sections"),
        F.size(M.code_citations(body)).cast("bigint").alias("citations"),
        count(lambda l: strip_start(l).startswith("|")).alias("table_lines"),
        F.col("_head").isNotNull().alias("has_claims"),
        F.coalesce(
            F.size(F.filter("_lines", lambda l, i: (i > F.col("_head")) & strip_start(l).startswith("- "))), F.lit(0)
        ).cast("bigint").alias("claims"),
        F.contains(body, F.lit(MERMAID)).alias("has_diagram"),
        first_marker(body, PLACEHOLDERS).alias("placeholder"),
        pollution(body).alias("pollution"),
        (F.contains(body, F.lit("职责")) & F.contains(body, F.lit("非职责"))).alias("has_duties"),
        body.rlike("上手要点|先读").alias("has_first_steps"),
        body.rlike("术语|Glossary").alias("has_glossary"),
    )


def gaps(features: DataFrame) -> DataFrame:
    """Features plus the array of bars a page misses for its type, in a fixed order."""
    kind = F.col("page_type")
    min_chars = F.when(kind.isin(*SHORT_TYPES), MIN_CHARS_SHORT).otherwise(MIN_CHARS)
    min_sections = F.when(kind == "Module", MIN_SECTIONS_MODULE).otherwise(MIN_SECTIONS)
    tests = [
        ("chars", F.col("chars") < min_chars),
        ("sections", F.col("sections") < min_sections),
        ("citations", F.col("citations") < MIN_CITATIONS),
        ("placeholder", F.col("placeholder").isNotNull()),
        ("pollution", F.col("pollution").isNotNull()),
        ("duties", (kind == "Module") & ~F.col("has_duties")),
        ("first_steps", (kind == "Module") & ~F.col("has_first_steps")),
        ("glossary", (kind == "Business") & ~F.col("has_glossary")),
        ("stages", (kind == "Workflow") & ~F.col("has_diagram")),
        ("table", F.col("table_lines") < MIN_TABLE_LINES),
        ("diagram", kind.isin(*DIAGRAM_TYPES) & ~F.col("has_diagram")),
        ("claims_section", ~F.col("has_claims")),
        ("claims", F.col("has_claims") & (F.col("claims") < MIN_CLAIMS)),
    ]
    missed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return features.withColumn("gaps", missed)


def quality_report(pages: DataFrame) -> DataFrame:
    return gaps(depth_features(pages))


def existing_targets(pages: DataFrame) -> DataFrame:
    """Every path a link may point to: pages and the folders above them, deduplicated map-side."""
    from corpus_kb.functions.text import path_prefixes

    return pages.select(F.explode(path_prefixes(F.col("path"))).alias("p")).select(F.col("p.prefix").alias("to_path")).distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """Relative links that resolve to neither a page nor a folder: ``from_path, target``.

    A link target may be hot, but it sits on the probed side of an anti-join with distinct paths.
    """
    return page_links(pages).join(existing_targets(pages), "to_path", "left_anti").select("from_path", "target")


def integrity_problems(pages: DataFrame) -> DataFrame:
    """Missing required pages, a near-empty entry page and broken links: ``problem, path, detail``."""
    spark = pages.sparkSession
    required = spark.createDataFrame([(p,) for p in REQUIRED_PAGES], "path string")
    # the required names reach the page scan as a pushed-down IN filter
    present = pages.filter(F.col("path").isin(*REQUIRED_PAGES))
    missing = required.join(present.select("path"), "path", "left_anti").select(
        F.lit("missing").alias("problem"), "path", F.lit("").alias("detail")
    )
    short = pages.filter((F.col("path") == REQUIRED_PAGES[0]) & (F.length(strip(F.col("body"))) < ENTRY_MIN_CHARS)).select(
        F.lit("short").alias("problem"), "path", F.lit("").alias("detail")
    )
    broken = broken_links(pages).select(F.lit("broken link").alias("problem"), F.col("from_path").alias("path"), F.col("target").alias("detail"))
    return missing.unionByName(short).unionByName(broken)

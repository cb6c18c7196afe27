"""Quality and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.functions import markdown as M
from corpus_kb.functions.text import is_blank
from corpus_kb.functions.transcripts import DRAFT_MARKER
from corpus_kb.operators import quality as Q
from corpus_kb.sources import tables as T

MARKERS = ("the the", "@", "http", "###")


def typed(spark, d):
    """Pages of all types with code spans, tables, diagrams and claims added by document number."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Module", "Business", "Workflow", "Quickstart", "Reference")]), (F.col("doc_id") % 5 + 1).cast("int"))
    extra = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.lit("| a | b |\n| - | - |\n| c | d |\n")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("see `src/a.rs` and `snake_case`\n"), F.lit(4))).otherwise(F.lit("`short x`\n")),
        F.when(F.col("doc_id") % 7 == 0, F.lit("TBD\n")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 11 == 0, F.lit("<tool_call>\n")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 4 == 0, F.lit("```mermaid\ngraph LR\n```\n")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 5 < 3, F.concat(F.lit("## Claims\n"), F.repeat(F.lit("- one more fact\n"), (F.col("doc_id") % 8).cast("int")))).otherwise(F.lit("")),
    )
    md = T.markdown_docs(spark, d)
    return md.select("path", kind.alias("page_type"), F.concat("body", extra).alias("body"))


_BASE = """SELECT d.path, d.doc_id, CASE doc_id % 5 WHEN 0 THEN 'Module' WHEN 1 THEN 'Business' WHEN 2 THEN 'Workflow' WHEN 3 THEN 'Quickstart' ELSE 'Reference' END AS page_type,
    length(t.body) AS md_chars, h2, tb, mt, m.dash, contains(t.body, 'TBD') AS tbd, t.body FROM f_docs d JOIN f_mdtext t ON d.path = t.path
    JOIN (SELECT path, count(*) FILTER (starts_with(ltrim(line), '## ')) AS h2, count(*) FILTER (starts_with(ltrim(line), '|')) AS tb, count(*) FILTER (starts_with(ltrim(line), '- ')) AS dash, bool_or(starts_with(ltrim(line), '#') AND contains(line, 'Claims')) AS mt FROM f_md GROUP BY path) m ON d.path = m.path"""
_FEATURES = """SELECT path, page_type, md_chars + CASE WHEN doc_id % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 128 ELSE 10 END + CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 0 END
      + CASE WHEN doc_id % 11 = 0 THEN 12 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 24 ELSE 0 END + CASE WHEN doc_id % 5 < 3 THEN 10 + 16 * (doc_id % 8) ELSE 0 END AS chars,
    h2 + CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END AS sections, CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 0 END AS own_citations, tb + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS table_lines,
    doc_id % 5 < 3 AS has_claims, CASE WHEN doc_id % 5 < 3 THEN doc_id % 8 ELSE 0 END AS claims, doc_id % 4 = 0 AS has_diagram,
    CASE WHEN doc_id % 7 = 0 OR tbd THEN 'TBD' END AS placeholder, CASE WHEN doc_id % 11 = 0 THEN '<tool_call' END AS pollution FROM base"""


def page_set(spark, d):
    """Linked pages in which document 0 is the entry page and document 1 the README."""
    p = T.linked_docs(spark, d)
    name = F.when(F.col("path") == "d/src0/0.md", "quickstart.md").when(F.col("path") == "d/src1/1.md", "README.md").otherwise(F.col("path"))
    return p.select(name.alias("path"), F.when(F.col("path") == "d/src0/0.md", "short").otherwise(F.col("body")).alias("body"))


_CITES = """SELECT path, coalesce(len(list_filter(list_filter(string_split(full_text, '`'), lambda x, i: i % 2 = 0), lambda s: octet_length(encode(trim(s, chr(32)||chr(10)))) >= 4 AND NOT regexp_matches(trim(s, chr(32)||chr(10)), '\\s')
              AND ((regexp_matches(s, '\\pL') AND regexp_matches(s, '[/.(]|::')) OR (regexp_full_match(trim(s, chr(32)||chr(10)), '[\\pL\\pN_]+') AND regexp_matches(s, '_|\\p{Lu}'))))), 0) AS citations FROM
            (SELECT path, concat(body, CASE WHEN doc_id % 2 = 0 THEN '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| c | d |' || chr(10) ELSE '' END,
               CASE WHEN doc_id % 3 = 0 THEN repeat('see `src/a.rs` and `snake_case`' || chr(10), 4) ELSE '`short x`' || chr(10) END, CASE WHEN doc_id % 7 = 0 THEN 'TBD' || chr(10) ELSE '' END,
               CASE WHEN doc_id % 11 = 0 THEN '<tool_call>' || chr(10) ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '```mermaid' || chr(10) || 'graph LR' || chr(10) || '```' || chr(10) ELSE '' END,
               CASE WHEN doc_id % 5 < 3 THEN '## Claims' || chr(10) || repeat('- one more fact' || chr(10), (doc_id % 8)::int) ELSE '' END) AS full_text FROM base)"""
_ALL_FEATURES = """SELECT f.* EXCLUDE (own_citations), citations, contains(b.body, '职责') AND contains(b.body, '非职责') AS has_duties,
    regexp_matches(b.body, '上手要点|先读') AS has_first_steps, regexp_matches(b.body, '术语|Glossary') AS has_glossary
    FROM feats f JOIN cites c ON f.path = c.path JOIN base b ON f.path = b.path"""
FEATURES = (lambda s, d: Q.depth_features(typed(s, d)), with_views("SELECT * FROM features", base=_BASE, feats=_FEATURES, cites=_CITES, features=_ALL_FEATURES))
REPORT = (
    lambda s, d: Q.quality_report(typed(s, d)).withColumn("gaps", F.array_join("gaps", ",")),
    with_views("""SELECT *, array_to_string(list_filter([CASE WHEN chars < CASE WHEN page_type = 'Quickstart' THEN 1000 ELSE 1200 END THEN 'chars' END, CASE WHEN sections < CASE WHEN page_type = 'Module' THEN 5 ELSE 4 END THEN 'sections' END,
        CASE WHEN citations < 8 THEN 'citations' END, CASE WHEN placeholder IS NOT NULL THEN 'placeholder' END, CASE WHEN pollution IS NOT NULL THEN 'pollution' END,
        CASE WHEN page_type = 'Module' AND NOT has_duties THEN 'duties' END, CASE WHEN page_type = 'Module' AND NOT has_first_steps THEN 'first_steps' END,
        CASE WHEN page_type = 'Business' AND NOT has_glossary THEN 'glossary' END, CASE WHEN page_type = 'Workflow' AND NOT has_diagram THEN 'stages' END, CASE WHEN table_lines < 3 THEN 'table' END,
        CASE WHEN page_type IN ('Workflow', 'Module') AND NOT has_diagram THEN 'diagram' END, CASE WHEN NOT has_claims THEN 'claims_section' END, CASE WHEN has_claims AND claims < 5 THEN 'claims' END], lambda x: x IS NOT NULL), ',') AS gaps FROM features""",
        base=_BASE, feats=_FEATURES, cites=_CITES, features=_ALL_FEATURES),
)

ENTRIES = {
    "P12_draft_filter": (
        lambda s, d: T.docs(s, d).withColumn("body", F.when(F.col("n_chars") % 3 == 0, F.concat("body", F.lit(DRAFT_MARKER))).when(F.col("n_chars") % 3 == 1, F.lit(" \n")).otherwise(F.col("body")))
        .filter(~F.contains("body", F.lit(DRAFT_MARKER)) & ~is_blank(F.col("body"))).select("path"),
        with_views("SELECT path FROM f_docs WHERE n_chars % 3 = 2 AND trim(body) <> ''"),
    ),
    "P20_pollution": (
        lambda s, d: T.docs(s, d).select("path", Q.pollution(F.col("body"), MARKERS).alias("marker")),
        with_views("SELECT path, CASE WHEN contains(body, 'the the') THEN 'the the' WHEN contains(body, '@') THEN '@' WHEN contains(body, 'http') THEN 'http' WHEN contains(body, '###') THEN '###' END AS marker FROM f_docs"),
    ),
    "P21_placeholders": (
        lambda s, d: typed(s, d).select("path", Q.first_marker(F.col("body"), Q.PLACEHOLDERS).alias("placeholder")),
        with_views("SELECT path, CASE WHEN doc_id % 7 = 0 OR tbd THEN 'TBD' END AS placeholder FROM base", base=_BASE),
    ),
    "A13_code_citations": (
        lambda s, d: typed(s, d).select("path", F.size(M.code_citations(F.col("body"))).cast("bigint").alias("citations")),
        with_views("SELECT path, citations FROM cites", base=_BASE, cites=_CITES),
    ),
    "A12_depth_features": FEATURES,
    "A12_depth_features_whole": FEATURES,
    "Q1_quality_report": REPORT,
    "Q1_quality_report_whole": REPORT,
    "J4_broken_links": (
        lambda s, d: Q.broken_links(T.linked_docs(s, d)),
        with_views("SELECT DISTINCT from_path, target FROM f_mdlinks WHERE to_path NOT IN (SELECT path FROM f_docs)"),
    ),
    "Q3_integrity_check": (
        lambda s, d: Q.integrity_problems(page_set(s, d)),
        with_views("""SELECT 'missing' AS problem, 'index.md' AS path, '' AS detail UNION ALL SELECT 'short', 'quickstart.md', ''
            UNION ALL SELECT 'broken link', CASE from_path WHEN 'd/src1/1.md' THEN 'README.md' ELSE from_path END, target FROM f_mdlinks
            WHERE from_path <> 'd/src0/0.md' AND (from_path = 'd/src1/1.md' OR to_path NOT IN (SELECT path FROM f_docs WHERE path NOT IN ('d/src0/0.md', 'd/src1/1.md')))"""),
    ),
}

"""Line search, outlines and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.functions.text import clip, lines
from corpus_kb.operators import graph as G
from corpus_kb.operators import outline as O
from corpus_kb.sources import tables as T

_DECL = """SELECT repo, rel, line_no AS line,
    CASE WHEN starts_with(line, 'pub fn ') THEN 'fn' ELSE 'class' END AS kind,
    CASE WHEN starts_with(line, 'pub fn ') THEN regexp_extract(line, '^pub fn ([A-Za-z]+)', 1) ELSE regexp_extract(line, '^class ([A-Za-z]+)', 1) END AS name,
    row_number() OVER (PARTITION BY rel ORDER BY line_no) AS rn
    FROM f_src WHERE (language = 'rust' AND line_no % 4 = 1 AND regexp_matches(line, '^pub fn [A-Za-z]'))
       OR (language IN ('python', 'typescript') AND line_no % 4 = 2 AND regexp_matches(line, '^class [A-Za-z]'))"""


def lines_view(spark, d):
    return O.numbered_lines(T.docs(spark, d).withColumnRenamed("body", "text"), "path")


def indented(spark, d):
    """Documents whose lines start with two blanks."""
    body = F.concat(F.lit("  "), F.replace("body", F.lit("\n"), F.lit("\n  ")))
    return T.docs(spark, d).select("path", body.alias("text"))


def cargo(spark, d):
    body = F.concat(
        F.lit('[package]\nname = "'), "source", F.lit('-'), F.col("doc_id").cast("string"), F.lit('"\n\n[dependencies]\n'), F.col("lang"),
        F.lit(' = "1"\n"'), "source", F.lit('" = { version = "1" }\n[profile]\nx = 1\n'),
    )
    return O.manifest_entries(T.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/Cargo.toml")).alias("rel"), body.alias("text")))


def json_keys(spark, d):
    return O.manifest_entries(
        T.table(spark, d, "events").select(
            F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit("/package.json")).alias("rel"),
            F.concat(F.lit('{"name":"'), "event_type", F.lit('","dependencies":'), "props", F.lit("}")).alias("text"),
        )
    )


def other_manifests(spark, d):
    """A ``go.mod`` and a ``pyproject.toml`` for each document."""
    docs, number = T.table(spark, d, "documents"), F.col("doc_id").cast("string")
    go = F.concat(F.lit("module corp/"), "source", F.lit("\n\nrequire (\n\t"), "lang", F.lit("/lib v1\n)\n\nrequire (\n\t"), "lang", F.lit("/more v2\n)\n"))
    python = F.concat(F.lit('[project]\nname = "'), "source", F.lit("-"), number, F.lit('"\ndependencies = ["'), "lang", F.lit('>=1"]\n'))
    made = lambda name, text: docs.select(F.concat("source", F.lit("/"), number, F.lit("/" + name)).alias("rel"), text.alias("text"))
    return O.manifest_entries(made("go.mod", go).unionByName(made("pyproject.toml", python)))


GREP = (
    lambda s, d: O.grep(indented(s, d), "THE ", key="path"),
    with_views("""SELECT path, line_no, CASE WHEN length(rtrim(x)) > 400 THEN left(rtrim(x), 400) || '…' ELSE rtrim(x) END AS line
        FROM (SELECT *, concat('  ', line) AS x FROM f_lines) l WHERE contains(lower(x), 'the ')"""),
)
DEFINITIONS = (
    lambda s, d: O.find_definitions(T.source_texts(s, d), "The"),
    with_views("""SELECT repo, rel, line_no, trim(line) AS line FROM f_src WHERE language IS NOT NULL
        AND (line = 'class The:' OR starts_with(line, 'pub fn The('))"""),
)
OUTLINE = (lambda s, d: O.outline(T.source_texts(s, d)), with_views(f"SELECT repo, rel, line, kind, name FROM ({_DECL}) x"))

ENTRIES = {
    "W1_numbered_lines": (
        lines_view, with_views("SELECT path, line_no, line FROM f_lines"),
    ),
    "P8_grep": GREP,
    "P8_grep_whole_texts": GREP,
    "P9_find_definitions": DEFINITIONS,
    "P9_find_definitions_whole": DEFINITIONS,
    "P10_read_window": (
        lambda s, d: O.read_window(T.source_texts(s, d), "src5/en/5.rs", 2, 6).unionByName(O.read_window(T.source_texts(s, d), "src0/en/0.rs")),
        with_views("""SELECT rel, line_no, CASE WHEN length(rtrim(line)) > 400 THEN left(rtrim(line), 400) || '…' ELSE rtrim(line) END AS line, total,
            CASE WHEN total > hi THEN hi + 1 END AS next_start FROM
            (SELECT *, count(*) OVER (PARTITION BY rel) AS total, CASE WHEN rel = 'src5/en/5.rs' THEN 6 ELSE 120 END AS hi, CASE WHEN rel = 'src5/en/5.rs' THEN 2 ELSE 1 END AS lo
             FROM f_src WHERE rel IN ('src5/en/5.rs', 'src0/en/0.rs')) WHERE line_no BETWEEN lo AND hi"""),
    ),
    "P11_line_clip": (
        lambda s, d: T.docs(s, d).select("path", F.explode(F.array_distinct(F.transform(lines(F.col("body")), lambda l: clip(l, 60)))).alias("clipped")),
        with_views("SELECT DISTINCT path, CASE WHEN length(rtrim(line)) > 60 THEN left(rtrim(line), 60) || '…' ELSE rtrim(line) END AS clipped FROM f_lines"),
    ),
    "P17_G10_symbol_table": (
        lambda s, d: O.symbol_table(T.source_texts(s, d)),
        with_views(f"SELECT repo, rel, kind, name FROM ({_DECL}) x WHERE (kind = 'fn') OR ends_with(rel, '.py')"),
    ),
    "G10_symbol_rows": (
        lambda s, d: G.symbol_rows(O.symbol_table(T.source_texts(s, d))),
        with_views(f"""SELECT DISTINCT concat('sym_', left(sha256(concat_ws(chr(10), repo, rel, kind, name)), 16)) AS id, repo, rel AS path, name, kind,
            concat('ent_', left(sha256(concat('symbol:', repo, '/', rel)), 16)) AS entity_id FROM ({_DECL}) x WHERE kind = 'fn' OR ends_with(rel, '.py')"""),
    ),
    "P18_F22_file_outline": OUTLINE,
    "P18_F22_file_outline_whole": OUTLINE,
    "A19_outline_summary": (
        lambda s, d: O.outline_summary(T.source_texts(s, d), 14, 4200, 8),
        with_views(
            """SELECT repo, pos, rel, line FROM (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY repo ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM
              (SELECT f.repo, f.pos, f.rel, CASE WHEN d.decls IS NULL THEN concat('- `', f.rel, '` (', f.language, ')', chr(10))
                 ELSE concat('- `', f.rel, '` (', f.language, ', ', f.size, ' B): ', d.decls, chr(10)) END AS line
               FROM ranked f LEFT JOIN (SELECT rel, string_agg(concat('`', line, '` ', kind, ' ', name), ' · ' ORDER BY line) AS decls FROM decl WHERE rn <= 8 GROUP BY rel) d ON f.rel = d.rel))
              WHERE used <= 4200""",
            decl=_DECL,
            ranked="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size DESC, rel) AS pos FROM f_files WHERE language IS NOT NULL) WHERE pos <= 14",
        ),
    ),
    "S9_W16_manifest_sections": (
        cargo,
        """SELECT DISTINCT concat(source, '/', doc_id, '/Cargo.toml') AS rel, k.kind,
            CASE k.i WHEN 0 THEN concat(source, '-', doc_id) WHEN 1 THEN lang ELSE source END AS name
            FROM documents, (VALUES (0, 'package'), (1, 'dep'), (2, 'dep')) k(i, kind)""",
    ),
    "S9_other_manifests": (
        other_manifests,
        """SELECT DISTINCT concat(source, '/', doc_id, '/', f) AS rel, 'dep' AS kind, lang || more AS name
            FROM documents, (VALUES ('go.mod', '/lib'), ('go.mod', '/more'), ('pyproject.toml', '>=1')) a(f, more)""",
    ),
    "S9_manifest_json_keys": (
        json_keys,
        """SELECT concat('e/', event_id, '/package.json') AS rel, 'package' AS kind, event_type AS name FROM events
           UNION ALL SELECT concat('e/', event_id, '/package.json'), 'dep', k FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)""",
    ),
}

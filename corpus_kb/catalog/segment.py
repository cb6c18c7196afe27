"""Sections, chunks, folding and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.functions import markdown as M
from corpus_kb.functions.text import approx_tokens, content_hash, is_blank, strip, trim_line_ends
from corpus_kb.operators import segment as G
from corpus_kb.sources import tables as T

_SECTIONS = """SELECT path, sec - 1 AS section, min(line_no) AS start_line, max(line_no) AS end_line,
    CASE WHEN starts_with(arg_min(line, line_no), '#') AND NOT bool_or(in_fence) FILTER (line_no = lo) THEN trim(ltrim(arg_min(line, line_no), '#')) ELSE 'Overview' END AS title,
    string_agg(line, chr(10) ORDER BY line_no) AS body
    FROM (SELECT *, min(line_no) OVER (PARTITION BY path, sec) AS lo FROM
      (SELECT *, sum(CASE WHEN line_no = 1 OR (NOT in_fence AND starts_with(line, '#')) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS sec FROM f_fence))
    GROUP BY path, sec"""

_ISLANDS = """SELECT path, line_no, line, count(*) OVER (PARTITION BY path, isl) AS run, row_number() OVER (PARTITION BY path, isl ORDER BY line_no) AS k
    FROM (SELECT *, sum(CASE WHEN line IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS isl
          FROM (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM f_lines))"""

_COLLAPSED = """SELECT path, string_agg(CASE WHEN trim(line) = '' THEN '' ELSE line END, chr(10) ORDER BY line_no) AS body FROM
    (SELECT *, lag(trim(line) = '') OVER (PARTITION BY path ORDER BY line_no) AS pb, min(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY path) AS lo,
       max(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY path) AS hi FROM {lines})
    WHERE line_no BETWEEN lo AND hi AND NOT (trim(line) = '' AND coalesce(pb, false)) GROUP BY path"""


# the greedy split is a recursion over the lines of each page: a piece closes once it reaches the target outside a fence
_WALK = """SELECT path, line_no, line, 1 AS seg, CASE WHEN NOT in_fence AND starts_with(line, '#') THEN trim(ltrim(line, '#')) ELSE 'Overview' END AS title,
      length(line) + 1 AS chars, length(line) // 3 + 1 >= 512 AND NOT in_fence AS full_ FROM f_fence WHERE line_no = 1
    UNION ALL SELECT path, line_no, line, seg, title, chars, (chars - 1) // 3 + 1 >= 512 AND NOT in_fence AS full_ FROM
      (SELECT l.path, l.line_no, l.line, l.in_fence, w.seg + CASE WHEN w.full_ OR (NOT l.in_fence AND starts_with(l.line, '#')) THEN 1 ELSE 0 END AS seg,
         CASE WHEN NOT l.in_fence AND starts_with(l.line, '#') THEN trim(ltrim(l.line, '#')) ELSE w.title END AS title,
         CASE WHEN w.full_ OR (NOT l.in_fence AND starts_with(l.line, '#')) THEN 0 ELSE w.chars END + length(l.line) + 1 AS chars
       FROM walk w JOIN f_fence l ON l.path = w.path AND l.line_no = w.line_no + 1)"""
_WS = "chr(32)||chr(9)||chr(10)||chr(13)"
_PIECES = f"""SELECT *, row_number() OVER (PARTITION BY path ORDER BY seg) AS k, lag(body) OVER (PARTITION BY path ORDER BY seg) AS prev FROM
    (SELECT path, seg, any_value(title) AS title, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS body FROM walk GROUP BY path, seg)
    WHERE trim(body, {_WS}) <> ''"""
_GROUPED = f"""SELECT *, row_number() OVER (PARTITION BY path, g ORDER BY seg) AS i, count(*) OVER (PARTITION BY path, g) AS n FROM
    (SELECT *, sum(CASE WHEN prev IS NULL OR length(trim(body, {_WS})) >= 400 OR ends_with(rtrim(prev, {_WS}), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seg) AS g FROM pieces)"""
_MERGED = f"""SELECT path AS page_path, g - 1 AS ord, arg_min(title, seg) AS title, min(start_line) AS start_line, max(end_line) AS end_line, arg_min(body, seg) AS first_body,
    string_agg(CASE WHEN n = 1 THEN body WHEN i = 1 THEN rtrim(body, {_WS}) WHEN i = n THEN ltrim(body, {_WS}) ELSE trim(body, {_WS}) END, chr(10)||chr(10) ORDER BY seg) AS body FROM grouped GROUP BY path, g"""
_CHUNKED = f"""SELECT concat('ck_', left(sha256(concat(page_path, ord::bigint, body)), 12)) AS chunk_id, page_path, ord::bigint AS ord, title, start_line, end_line, body,
    CASE WHEN length(coalesce(s, '')) >= 20 THEN s ELSE title END AS summary, 'structural|structural|512|llm=false' AS source FROM
    (SELECT *, left(list_filter(list_transform(string_split(first_body, chr(10)), lambda x: trim(x, {_WS})),
        lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '```') AND NOT starts_with(x, '---'))[1], 180) AS s FROM merged)"""


def claim_docs(spark, d):
    """Markdown pages in which every second heading announces claims and prose lines are bullets."""
    return with_claims(T.markdown_docs(spark, d))


def with_claims(md):
    marked = F.regexp_replace("body", r"(?m)^## ([A-M])", "## Claims $1")
    return md.withColumn("body", F.regexp_replace(marked, r"(?m)^([^#`\n])", "- $1"))


def heading_docs(spark, d):
    return T.markdown_docs(spark, d).withColumn("body", F.regexp_replace("body", r"(?m)^## (?=[A-E])", "# "))


def model_docs(spark, d):
    """Documents whose model answer is usable for one language and prose elsewhere."""
    item = F.struct(F.lit(" T ").alias("title"), F.lit("").alias("summary"), F.col("body"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    answer = F.when(F.col("lang") == "en", F.concat(F.lit("Sure:\n"), F.to_json(F.array(item)), F.lit("\nDone."))).otherwise(F.lit("no chunks"))
    return T.markdown_docs(spark, d).withColumn("answer", answer)


def front_pages(spark, d):
    """Page files with front matter, but for one language."""
    head = F.concat(F.lit("---\ntitle: "), "source", F.lit("\ntype: "), "lang", F.lit("\n---\n\n"))
    return T.docs(spark, d).withColumn("file", F.concat(F.when(F.col("lang") != "fr", head).otherwise(F.lit("")), "body"))


ENTRIES = {
    "F11_front_matter_split": (
        lambda s, d: front_pages(s, d).select("path", M.front_matter(F.col("file")).alias("fields"), M.strip_front_matter(F.col("file")).alias("rest")).select(
            "path", F.col("fields")["title"].alias("title"), F.col("fields")["type"].alias("page_type"), F.sha2("rest", 256).alias("rest")),
        with_views("""SELECT path, CASE WHEN lang <> 'fr' THEN source END AS title, CASE WHEN lang <> 'fr' THEN lang END AS page_type,
            sha256(CASE WHEN lang <> 'fr' THEN ltrim(body, chr(10)||chr(13)) ELSE body END) AS rest FROM f_docs"""),
    ),
    "W2_chunk_ordinals": (
        lambda s, d: T.chunks(s, d).select("page_path", "ord", "start_line", "end_line"),
        with_views("SELECT page_path, ord, start_line, end_line FROM f_cut"),
    ),
    "W3_fence_state": (
        lambda s, d: G.fence_state(T.markdown_docs(s, d)),
        with_views("SELECT path, line_no, line, in_fence FROM f_fence"),
    ),
    "W4_sections": (
        lambda s, d: G.sections(T.markdown_docs(s, d)),
        with_views(f"SELECT * FROM ({_SECTIONS})"),
    ),
    "W7_fold_identical_runs": (
        lambda s, d: G.fold_runs(T.docs(s, d)),
        with_views("""SELECT path, line_no, CASE WHEN fold THEN concat(line, '  (x', run, ')') ELSE line END AS text,
            CASE WHEN fold THEN run ELSE 1 END AS run, CASE WHEN fold THEN gain ELSE 0 END AS saved FROM
            (SELECT *, run >= 4 AND trim(line) <> '' AND gain > 0 AS fold FROM
              (SELECT *, (run - 1) * (length(line) + 1) - length(concat('  (x', run, ')')) AS gain FROM isl))
            WHERE NOT fold OR k = 1""", isl=_ISLANDS),
    ),
    "W8_collapse_blank_runs": (
        lambda s, d: G.collapse_blanks(T.markdown_docs(s, d)), with_views(f"SELECT * FROM ({_COLLAPSED.format(lines='f_md')})"),
    ),
    "W14_first_heading": (
        lambda s, d: G.first_headings(heading_docs(s, d)),
        with_views("""SELECT d.path, coalesce(h.title, d.path) AS title FROM f_docs d LEFT JOIN
            (SELECT path, arg_min(left(trim(substr(line, 3)), 120), line_no) AS title FROM
               (SELECT path, line_no, in_fence, CASE WHEN regexp_matches(line, '^## [A-E]') THEN substr(line, 2) ELSE line END AS line FROM f_fence)
             WHERE NOT in_fence AND starts_with(trim(line), '# ') GROUP BY path) h ON d.path = h.path"""),
    ),
    "W13_Q2_claims": (
        lambda s, d: G.claims(claim_docs(s, d)).withColumn("evidence", F.array_join("evidence", ",")),
        with_views("""SELECT path AS page_path, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS ord, substr(line, 3) AS statement,
            concat('kb://', path) AS evidence, 'active' AS status FROM
            (SELECT *, last_value(claim IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS inside FROM
              (SELECT *, CASE WHEN starts_with(line, '#') THEN contains(lower(line), 'claim') END AS claim FROM
                (SELECT path, line_no, trim(CASE WHEN regexp_matches(line, '^## [A-M]') THEN '## Claims ' || substr(line, 4)
                    WHEN line <> '' AND NOT regexp_matches(line, '^[#`]') THEN '- ' || line ELSE line END) AS line FROM f_md)))
            WHERE inside AND starts_with(line, '- ') AND octet_length(encode(substr(line, 3))) >= 8"""),
    ),
    "W15_summaries": (
        lambda s, d: T.chunks(s, d).select("chunk_id", "summary"), with_views("SELECT chunk_id, summary FROM f_chunks"),
    ),
    "C1_W5_W6_structural_chunks": (
        lambda s, d: G.chunk_pages(T.markdown_docs(s, d)),
        with_views(f"SELECT * FROM ({_CHUNKED})", walk=_WALK, pieces=_PIECES, grouped=_GROUPED, merged=_MERGED),
    ),
    "C1_heading_chunks": (
        lambda s, d: G.chunk_pages(
            T.markdown_docs(s, d), target_tokens=10**9,
        ).groupBy("page_path").agg(F.count("*").alias("chunks"), F.max("end_line").alias("last_line")),
        with_views("""SELECT path AS page_path, count(*) FILTER (opens) AS chunks, max(end_line) AS last_line FROM
            (SELECT *, prev IS NULL OR length(trim(body, chr(32)||chr(10))) >= 400 OR ends_with(rtrim(prev, chr(32)||chr(10)), '```') AS opens FROM
              (SELECT *, lag(body) OVER (PARTITION BY path ORDER BY section) AS prev FROM sections WHERE trim(body, chr(32)||chr(10)) <> ''))
            GROUP BY path""", sections=_SECTIONS),
    ),
    "C2_C3_model_chunks": (
        lambda s, d: G.chunk_pages(model_docs(s, d), "hybrid", answer="answer"),
        with_views(f"""SELECT concat('ck_', left(sha256(concat(path, '0', body)), 12)) AS chunk_id, path AS page_path, 0::bigint AS ord, 'T' AS title, 'T' AS summary,
            body, 1::bigint AS start_line, 9::bigint AS end_line, 'llm-semantic|hybrid|512|llm=true' AS source
            FROM (SELECT t.path, lang, trim(t.body, chr(32)||chr(9)||chr(10)||chr(13)) AS body FROM f_mdtext t JOIN f_docs d ON t.path = d.path) WHERE lang = 'en' AND body <> ''
            UNION ALL BY NAME SELECT * REPLACE ('structural|hybrid|512|llm=true' AS source) FROM ({_CHUNKED}) WHERE page_path IN (SELECT path FROM f_docs WHERE lang <> 'en')""",
            walk=_WALK, pieces=_PIECES, grouped=_GROUPED, merged=_MERGED),
    ),
    "C4_chunk_ids": (
        lambda s, d: T.chunks(s, d).select("page_path", "ord", "chunk_id", F.lit(G.signature("hybrid", 512, False)).alias("signature")),
        with_views("SELECT page_path, ord, chunk_id, 'hybrid|512|llm=false' AS signature FROM f_chunks"),
    ),
    "Q4_F18_compaction": (
        lambda s, d: G.compaction(T.markdown_docs(s, d)),
        with_views("""SELECT t.path, c.body AS compacted, (length(t.body) - length(r.body)) + (length(r.body) - length(c.body)) AS removed
            FROM f_mdtext t JOIN (SELECT path, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS body FROM trimmed GROUP BY path) r ON t.path = r.path
            JOIN collapsed c ON t.path = c.path""",
            trimmed="SELECT path, line_no, rtrim(line) AS line FROM f_md", collapsed=_COLLAPSED.format(lines="trimmed")),
    ),
    "A17_chars_saved": (
        lambda s, d: G.saved_by_compaction(T.markdown_docs(s, d)),
        with_views("""SELECT count(*) AS pages, sum(length(t.body) - length(c.body)) AS saved_chars, sum(length(t.body) - length(c.body)) // 4 AS saved_tokens
            FROM f_mdtext t JOIN collapsed c ON t.path = c.path""",
            trimmed="SELECT path, line_no, rtrim(line) AS line FROM f_md", collapsed=_COLLAPSED.format(lines="trimmed")),
    ),
    "F_scalar_functions": (
        lambda s, d: T.docs(s, d).select(
            "doc_id", approx_tokens(F.col("body")).cast("bigint").alias("tokens"), content_hash(F.col("body")).alias("body_hash"),
            F.length(strip(F.col("body"))).cast("bigint").alias("trimmed"), F.contains(F.lower("body"), F.lit("the")).alias("has"),
            F.left("body", F.lit(20)).alias("head"), is_blank(F.col("body")).alias("blank"), F.length(trim_line_ends(F.col("body"))).cast("bigint").alias("line_ends"),
        ),
        with_views("""SELECT doc_id, length(body) // 3 + 1 AS tokens, sha256(body) AS body_hash, length(trim(body, chr(32)||chr(9)||chr(10)||chr(13))) AS trimmed,
            contains(lower(body), 'the') AS has, left(body, 20) AS head, trim(body) = '' AS blank,
            length(rtrim(regexp_replace(body, '[ \t\r]+' || chr(10), chr(10), 'g'), chr(32)||chr(9)||chr(13))) AS line_ends FROM f_docs"""),
    ),
}

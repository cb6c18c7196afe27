"""Shared pieces of the oracle SQL: the knowledge-base shapes over the base tables, in DuckDB's dialect."""

from __future__ import annotations

import re

VIEWS = {
    "f_docs": "SELECT concat('d/', source, '/', cast(doc_id AS varchar), '.md') AS path, text AS body, lang, source, doc_id, n_chars FROM documents",
    "f_files": """SELECT source AS repo, concat(source, '/', lang, '/', cast(doc_id AS varchar),
        CASE doc_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.go' ELSE '.bin' END) AS rel, n_chars AS size,
        CASE doc_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'go' END AS language FROM documents""",
    "f_lines": """SELECT path, line_no, l AS line
        FROM (SELECT path, unnest(string_split(body, chr(10))) AS l,
                     generate_subscripts(string_split(body, chr(10)), 1) AS line_no,
                     len(string_split(body, chr(10))) AS n FROM f_docs)
        WHERE NOT (line_no = n AND l = '')""",
    "f_md": """SELECT path, line_no, CASE WHEN line_no % 5 = 1 THEN concat('## ', substr(line, 1, 20))
        WHEN line_no % 11 = 7 OR line_no % 11 = 9 THEN '```'
        WHEN line_no % 13 = 4 THEN '' ELSE line END AS line FROM f_lines""",
    "f_mdtext": "SELECT path, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS body FROM f_md GROUP BY path",
    "f_fence": """SELECT path, line_no, line,
        sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) % 2 = 1 AS in_fence FROM f_md""",
    "f_cut": """SELECT path AS page_path, row_number() OVER (PARTITION BY path ORDER BY min(line_no)) - 1 AS ord,
        min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS body
        FROM (SELECT path, line_no, line, sum(CASE WHEN line_no % 5 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS sec FROM f_lines)
        GROUP BY path, sec""",
    "f_chunks": """SELECT concat('ck_', left(sha256(concat(page_path, cast(ord AS varchar), body)), 12)) AS chunk_id, page_path, ord, title,
        CASE WHEN length(coalesce(s, '')) >= 20 THEN s ELSE title END AS summary, body, start_line, end_line,
        'structural|hybrid|512|llm=false' AS source
        FROM (SELECT *, left(split_part(body, chr(10), 1), 40) AS title,
              left(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(13))),
                   lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '```') AND NOT starts_with(x, '---'))[1], 180) AS s FROM f_cut)""",
    "f_links": """SELECT DISTINCT url AS from_url, h AS target
        FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)""",
    "f_mdlinks": """SELECT concat('d/', source, '/', cast(doc_id AS varchar), '.md') AS from_path,
        concat('../src', cast((doc_id * 7 + 3) % 20 AS varchar), '/', cast((doc_id * 7 + 3) % 1300 AS varchar), '.md') AS target,
        concat('d/src', cast((doc_id * 7 + 3) % 20 AS varchar), '/', cast((doc_id * 7 + 3) % 1300 AS varchar), '.md') AS to_path FROM documents""",
    "f_entities": """SELECT concat('region:', r_name) AS canonical_key, 'region' AS kind, r_name AS name, 'active' AS status FROM region
        UNION ALL SELECT concat('nation:', n_name), 'nation', n_name, 'active' FROM nation
        UNION ALL SELECT concat('supplier:', s_name), 'supplier', s_name, CASE WHEN s_acctbal < 0 THEN 'retired' ELSE 'active' END FROM supplier
        UNION ALL SELECT concat('customer:', c_name), 'customer', c_name, CASE WHEN c_acctbal < 0 THEN 'retired' ELSE 'active' END FROM customer""",
    "f_edges": """SELECT concat('nation:', n_name) AS src, concat('region:', r_name) AS dst, 'part_of' AS rel, cast(1.0 AS double) AS confidence
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('supplier:', s_name), concat('nation:', n_name), 'part_of',
        CASE WHEN s_acctbal < 0 THEN cast(0.5 AS double) ELSE cast(0.9 AS double) END
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT concat('customer:', c_name), concat('nation:', n_name), 'part_of', cast(1.0 AS double)
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "f_runs": """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status,
        o_orderpriority AS mode, o_orderdate AS created_at FROM orders""",
    "f_calls": """SELECT l_orderkey AS run_id, cast(l_linenumber AS bigint) AS call_no, l_returnflag AS stage,
        cast(floor(l_quantity) AS bigint) AS prompt_tokens,
        cast(floor(l_quantity * l_discount) AS bigint) AS cached_tokens, l_shipdate AS created_at FROM lineitem""",
    "f_tools": "SELECT user_id AS conv, event_id AS seq, event_type AS name, props AS args, ts FROM events",
    "f_deps": "SELECT p_brand AS owner, p_type AS dep FROM part",
    "f_conv": "SELECT conv_id, turn, role, text FROM conversations",
    "f_bench": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "f_src": """SELECT repo, rel, language, line_no, CASE line_no % 4
          WHEN 1 THEN concat('pub fn ', regexp_extract(line, '([A-Za-z]+)', 1), '(x: u8) {')
          WHEN 2 THEN concat('class ', regexp_extract(line, '([A-Za-z]+)', 1), ':')
          WHEN 3 THEN concat('// TODO ', line) ELSE line END AS line
        FROM (SELECT l.path, l.line_no, l.line, d.source AS repo,
          concat(d.source, '/', d.lang, '/', cast(d.doc_id AS varchar),
            CASE d.doc_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.go' ELSE '.bin' END) AS rel,
          CASE d.doc_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'go' END AS language
          FROM f_lines l JOIN f_docs d ON l.path = d.path)""",
}


def with_views(body: str, **extra: str) -> str:
    """``WITH`` clause holding the views ``body`` refers to, dependencies first."""
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", sql) and name not in ordered:
                need(VIEWS[name])
                ordered.append(name)

    for sql in (*extra.values(), body):
        need(sql)
    ctes = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in ordered]
    # a view that refers to itself is a recursion
    recursive = {name for name, sql in extra.items() if re.search(rf"\b{name}\b", sql)}
    ctes += [f"{name} AS ({sql})" if name in recursive else f"{name} AS MATERIALIZED ({sql})" for name, sql in extra.items()]
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return (f"{keyword} {', '.join(ctes)} " if ctes else "") + body

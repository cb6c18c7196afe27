"""File, path and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.functions.code import SKIP_DIRS, directory_role, in_skipped_dir, is_text_extension, language
from corpus_kb.functions.globs import ignore_rules, matches_any, matches_glob
from corpus_kb.functions.text import basename, dirname, escapes_root, is_blank, strip, strip_end
from corpus_kb.operators import scan as S
from corpus_kb.sources import files as R
from corpus_kb.sources import tables as T

REDACT = ["**/7*.go", "src3/fr/**"]
RULES = "*.bin\n!*00.bin\nsrc1/\n/src2/de/**\n# comment\n"


def scan(spark, d):
    rules = ignore_rules(F.lit("src7/\n"))
    return R.keep_source_files(T.files(spark, d), rules=rules)


def ignore(spark, d):
    files = T.files(spark, d)
    per_repo = files.select("repo").distinct().withColumn("rules", ignore_rules(F.lit(RULES)))
    return R.keep_unignored(files, per_repo).select("rel")


def readme(spark, d):
    texts = T.table(spark, d, "documents").select(
        F.col("source").alias("repo"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/README.md")).alias("rel"), "text",
    )
    return R.readme_excerpts(texts)


def guarded(spark, d):
    return (
        T.table(spark, d, "documents").filter(F.octet_length("text") <= 8000)
        .filter(~F.contains(F.left("text", F.lit(1024)), F.lit("\x00")))
        .select("doc_id", R.bounded_excerpt(F.col("text"), 100).alias("excerpt"))
    )


def tree_listing(spark, d):
    return S.list_tree(T.docs(spark, d), depth=2, limit=200)


FILES = (
    lambda s, d: R.keep_source_files(T.files(s, d)).select("rel"),
    with_views("SELECT rel FROM f_files WHERE language IS NOT NULL OR size < 2000000"),
)

ENTRIES = {
    "S1_file_scan": (scan, with_views("SELECT repo, rel, language, size FROM f_files WHERE (language IS NOT NULL OR size < 2000000) AND repo <> 'src7'")),
    "S2_guarded_text_read": (guarded, "SELECT doc_id, left(text, 100) AS excerpt FROM documents WHERE octet_length(encode(text)) <= 8000"),
    "S3_readme_excerpt": (readme, """SELECT source AS repo, arg_min(left(text, 4000), concat(source, '/', lang, '/', cast(doc_id AS varchar), '/README.md')) AS excerpt
        FROM documents GROUP BY source"""),
    "S5_page_corpus": (
        lambda s, d: T.docs(s, d).filter(matches_glob(F.col("path"), "**/*.md") & ~F.col("path").startswith(".")).select("path", F.length("body").cast("bigint").alias("chars")),
        with_views("SELECT path, length(body) AS chars FROM f_docs"),
    ),
    "S6_point_page_read": (
        lambda s, d: R.page_at(T.docs(s, d), "d/src3/3.md").select("path", "body").unionByName(R.page_at(T.docs(s, d), "../d/src3/3.md").select("path", "body")),
        with_views("SELECT path, body FROM f_docs WHERE path = 'd/src3/3.md'"),
    ),
    "S7_table_reads": (
        lambda s, d: T.entities(s, d).select("canonical_key", "name").unionByName(T.edges(s, d).select(F.col("src").alias("canonical_key"), F.col("dst").alias("name"))),
        with_views("SELECT canonical_key, name FROM f_entities UNION ALL SELECT src, dst FROM f_edges"),
    ),
    "P1_language_classification": (
        lambda s, d: T.files(s, d).groupBy(F.coalesce(language(F.col("rel")), F.lit("-")).alias("language")).agg(F.count("*").alias("files")),
        with_views("SELECT coalesce(language, '-') AS language, count(*) AS files FROM f_files GROUP BY 1"),
    ),
    "P2_skip_directories": (
        lambda s, d: T.files(s, d).filter(~in_skipped_dir(F.col("rel"), [*SKIP_DIRS, "fr", "src4"])).select("rel"),
        with_views("SELECT rel FROM f_files WHERE split_part(rel, '/', 2) <> 'fr' AND split_part(rel, '/', 1) <> 'src4'"),
    ),
    "P3_J12_ignore_rules": (
        ignore,
        with_views("""SELECT rel FROM (SELECT rel, arg_max(negated, ord) FILTER (regexp_matches(rel, re)) AS neg
            FROM f_files, (VALUES (0, false, '\\.bin$'), (1, true, '00\\.bin$'), (2, false, '(^|/)src1/'), (3, false, '^src2/de/')) r(ord, negated, re)
            GROUP BY rel) WHERE coalesce(neg, true)"""),
    ),
    "P4_glob_filter": (
        lambda s, d: T.docs(s, d).filter(matches_glob(F.col("path"), "d/**/src1?/*5.md")).select("path"),
        with_views("SELECT path FROM f_docs WHERE regexp_matches(path, '^d/(.*/)?src1[^/]/[^/]*5\\.md$')"),
    ),
    "P5_redaction_filter": (
        lambda s, d: T.files(s, d).filter(~matches_any(F.col("rel"), REDACT)).select("rel"),
        with_views("SELECT rel FROM f_files WHERE NOT regexp_matches(rel, '^(.*/)?7[^/]*\\.go$') AND NOT starts_with(rel, 'src3/fr/')"),
    ),
    "P6_text_extension_filter": (
        lambda s, d: T.files(s, d).filter(is_text_extension(F.col("rel"))).select("rel"),
        with_views("SELECT rel FROM f_files WHERE NOT ends_with(rel, '.bin')"),
    ),
    "P7_list_files": (
        lambda s, d: S.glob_files(T.files(s, d), "**/en/*.rs", REDACT, 200).select("rel", "size"),
        with_views("SELECT rel, size FROM f_files WHERE regexp_matches(rel, '^(.*/)?en/[^/]*\\.rs$') ORDER BY rel LIMIT 200"),
    ),
    "P13_module_scope": (
        lambda s, d: S.in_scope(T.files(s, d), "src2/en").select("rel"),
        with_views("SELECT rel FROM f_files WHERE language IS NOT NULL AND starts_with(rel, 'src2/en/')"),
    ),
    "P14_entry_files": (
        lambda s, d: S.entry_files(T.files(s, d).withColumn("rel", F.concat(dirname(F.col("rel")), F.when(F.col("size") % 7 == 0, "/main.rs").otherwise("/x.rs"))), 20).select("rel"),
        with_views("SELECT rel FROM (SELECT concat(repo, '/', split_part(rel, '/', 2), '/main.rs') AS rel FROM f_files WHERE size % 7 = 0 AND language IS NOT NULL) ORDER BY rel LIMIT 20"),
    ),
    "P15_file_hints": (
        lambda s, d: S.file_hints(T.files(s, d).withColumn("rel", F.concat("rel", F.when(F.col("size") % 3 == 0, "/Schema.sql").when(F.col("size") % 3 == 1, "/lib.rs").otherwise("/package.json")))),
        with_views("""SELECT concat(rel, CASE size % 3 WHEN 0 THEN '/Schema.sql' WHEN 1 THEN '/lib.rs' ELSE '/package.json' END) AS rel,
            size % 3 = 0 AS data_model, false AS automation, size % 3 = 1 AS api, size % 3 = 2 AS manifest FROM f_files"""),
    ),
    "P16_directory_roles": (
        lambda s, d: T.entities(s, d).select(directory_role(F.col("canonical_key")).alias("role"), "canonical_key").groupBy("role").agg(F.count("*").alias("n")),
        with_views("""SELECT CASE WHEN contains(k, 'test') THEN '测试' WHEN contains(k, 'doc') THEN '文档'
            WHEN contains(k, 'web') OR contains(k, 'frontend') OR contains(k, 'ui') THEN '前端/UI' WHEN contains(k, 'cli') THEN '命令行入口'
            WHEN contains(k, 'server') OR contains(k, 'api') THEN '服务/API' WHEN contains(k, 'core') OR contains(k, 'lib') OR contains(k, 'src') THEN '核心逻辑'
            WHEN contains(k, 'store') OR contains(k, 'db') OR contains(k, 'data') THEN '存储/数据'
            WHEN contains(k, 'util') OR contains(k, 'common') OR contains(k, 'shared') THEN '共享工具' WHEN contains(k, 'config') THEN '配置'
            ELSE '见目录内入口文件' END AS role, count(*) AS n FROM (SELECT lower(canonical_key) AS k FROM f_entities) GROUP BY 1"""),
    ),
    "P22_kinds": (lambda s, d: S.kinds(T.entities(s, d)), with_views("SELECT DISTINCT kind FROM f_entities")),
    "A4_files_per_top_dir": (
        lambda s, d: S.files_per_top_dir(T.files(s, d)),
        with_views("SELECT split_part(rel, '/', 1) AS dir, count(*) AS files FROM f_files WHERE language IS NOT NULL GROUP BY 1"),
    ),
    "A5_module_detection": (
        lambda s, d: S.detect_modules(T.files(s, d).withColumn("rel", F.when(F.col("repo").isin("src1", "src2"), F.concat(F.lit("crates/"), "rel")).when(F.col("repo") == "src3", F.concat(F.lit("src/"), "rel")).otherwise(F.col("rel"))), 12),
        with_views("""SELECT repo, CASE WHEN repo IN ('src1', 'src2') THEN 'crates/' || repo WHEN repo = 'src3' THEN 'src/src3' ELSE repo END AS key,
            CASE WHEN repo IN ('src1', 'src2') THEN repo || ' [' || array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL))[1:3], '/') || ']' ELSE repo END AS label,
            CASE WHEN repo IN ('src1', 'src2') THEN 'crates/' || repo || '/' WHEN repo = 'src3' THEN 'src/src3/' ELSE repo || '/' END AS hint,
            count(*) AS files FROM f_files WHERE language IS NOT NULL GROUP BY repo"""),
    ),
    "A6_module_representatives": (
        lambda s, d: S.module_representatives(T.files(s, d)),
        with_views("SELECT repo, repo AS module, min(rel) AS path FROM f_files WHERE language IN ('rust', 'typescript', 'python') GROUP BY repo"),
    ),
    "A7_todo_hotspots": (
        lambda s, d: S.todo_hotspots(T.source_texts(s, d), 15),
        with_views("""SELECT rel, count(*) AS hits FROM f_src WHERE regexp_matches(line, 'TODO|FIXME|XXX') GROUP BY rel ORDER BY hits DESC, rel LIMIT 15"""),
    ),
    "A8_corpus_facts": (
        lambda s, d: S.corpus_facts(T.files(s, d)),
        with_views("""SELECT repo, count(*) AS files, count(language) AS source_files,
            coalesce(array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ', '), '') AS languages FROM f_files GROUP BY repo"""),
    ),
    "A14_documentation_tree": (
        lambda s, d: S.path_tree(T.docs(s, d)),
        with_views("""SELECT array_to_string(string_split(path, '/')[1:n], '/') AS prefix, n AS depth, n < len(string_split(path, '/')) AS is_dir, count(*) AS files
            FROM f_docs, (VALUES (1), (2), (3)) v(n) GROUP BY ALL"""),
    ),
    "A18_capped_lists": (
        lambda s, d: S.capped_lists(T.dependencies(s, d), "owner", "dep", 5),
        with_views("""SELECT owner, array_to_string(l[1:5], ', ') || CASE WHEN len(l) > 5 THEN ', …' ELSE '' END AS listed
            FROM (SELECT owner, list_sort(list(DISTINCT dep)) AS l FROM f_deps GROUP BY owner)"""),
    ),
    "J9_files_per_module_hint": (
        lambda s, d: S.files_per_hint(S.detect_modules(T.files(s, d), 12).select("repo", "hint"), T.files(s, d)),
        with_views("SELECT repo, repo || '/' AS hint, count(*) AS source_files FROM f_files WHERE language IS NOT NULL GROUP BY repo"),
    ),
    "L1_files_by_path": FILES,
    "L1_files_by_path_whole": FILES,
    "L8_L9_tree_listing": (
        tree_listing,
        with_views("""SELECT * FROM (SELECT array_to_string(string_split(path, '/')[1:n], '/') AS prefix, n AS depth, true AS is_dir, count(*) AS files
            FROM f_docs, (VALUES (1), (2)) v(n) GROUP BY ALL) ORDER BY prefix LIMIT 200"""),
    ),
    "L10_largest_files": (
        lambda s, d: S.largest_files(T.files(s, d), 14),
        with_views("SELECT rel, size FROM f_files WHERE language IS NOT NULL ORDER BY size DESC, rel LIMIT 14"),
    ),
    "F10_path_functions": (
        lambda s, d: T.files(s, d).select("rel", basename(F.col("rel")).alias("base"), dirname(F.col("rel")).alias("dir"), escapes_root(F.col("rel")).alias("escapes"), F.translate(F.col("rel"), "/\\ :", "----").alias("slug")),
        with_views("""SELECT rel, string_split(rel, '/')[-1] AS base, split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) AS dir, false AS escapes,
            replace(rel, '/', '-') AS slug FROM f_files"""),
    ),
}

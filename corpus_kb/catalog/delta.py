"""Upserts, pruning, fingerprints, reuse, reindexing, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.catalog.code import _DECL
from corpus_kb.catalog.segment import claim_docs, heading_docs
from corpus_kb.functions.transcripts import DRAFT_MARKER
from corpus_kb.operators import delta as D
from corpus_kb.operators import index as I
from corpus_kb.operators import segment as G
from corpus_kb.plans import evidence as E
from corpus_kb.plans import maintenance as N
from corpus_kb.session import shared_dir
from corpus_kb.sources import files as R
from corpus_kb.sources import sinks as K
from corpus_kb.sources import tables as T

_FP = """SELECT d.path, sha256(concat_ws(chr(10), 's1', d.lang, '', coalesce(g.n, 0)::varchar, coalesce(g.digest, 0)::varchar)) AS fingerprint
    FROM f_docs d LEFT JOIN digests g ON g.repo = d.source AND g.scope = CASE WHEN d.lang = 'en' THEN concat(d.source, '/en') ELSE '' END"""
_DIGESTS = """SELECT repo, scope, count(*) AS n, sum(h)::hugeint AS digest FROM (SELECT repo, unnest(['', repo, regexp_replace(rel, '/[^/]*$', '')]) AS scope,
    ('0x' || left(sha256(concat(rel, ':', size)), 12))::bigint AS h FROM f_files) GROUP BY repo, scope"""


def planned(spark, d):
    p = T.docs(spark, d)
    plan = p.select(
        F.col("source").alias("repo"), "path", F.when(F.col("lang") == "en", F.concat("source", F.lit("/en"))).alias("module"),
        F.col("lang").alias("focus"), F.lit("").alias("evidence"),
    )
    return D.fingerprints(plan, T.files(spark, d), "s1")


def stored(spark, d):
    """Stored pages: fingerprints are current for half of the sizes, outdated or template-made for others."""
    fp = planned(spark, d).join(T.docs(spark, d).select("path", "n_chars"), "path")
    h = F.when(F.col("n_chars") % 3 == 0, F.col("fingerprint")).when(F.col("n_chars") % 3 == 1, F.lit("old")).otherwise(F.lit("x+template"))
    return fp.select("path", h.alias("evidence_hash"))


def bodies(spark, d):
    mark = F.when(F.col("n_chars") % 5 == 0, F.lit(DRAFT_MARKER)).when(F.col("n_chars") % 7 == 0, F.lit("<function=")).otherwise(F.lit(""))
    return T.docs(spark, d).select("path", F.concat(F.lit("---\ntitle: x\n---\n\n"), mark, "body").alias("body"))


def plan(spark, d):
    return D.reuse_plan(planned(spark, d).select("path", "fingerprint"), stored(spark, d), bodies(spark, d), F.contains("body", F.lit("<function=")))


_PLAN = """SELECT f.path, fingerprint, CASE WHEN n_chars % 3 = 0 AND clean THEN 'reuse' ELSE 'generate' END AS action, clean AND n_chars % 3 <> 2 AS keep_on_failure
    FROM fp f JOIN (SELECT path, n_chars, n_chars % 5 <> 0 AND n_chars % 7 <> 0 AS clean FROM f_docs) d ON f.path = d.path"""


def outcomes(spark, d):
    jobs = plan(spark, d).join(T.docs(spark, d).select("path", "lang", F.col("body").alias("generated")), "path")
    return D.outcomes(jobs.withColumn("failed", F.col("lang") == "fr"), F.lit(False)).select("path", "outcome", F.right("fingerprint", F.lit(9)).alias("tail"))


def page_versions(spark, d):
    p = T.docs(spark, d)
    old = p.filter(F.col("lang") != "de").select("path", F.sha2("body", 256).alias("body_hash"), F.lit("run-0").alias("run_id"))
    new = p.filter(F.col("lang").isin("de", "fr")).select("path", F.lit("h").alias("body_hash"), F.explode(F.array(F.lit("run-1"), F.lit("run-2"))).alias("run_id"))
    return D.upsert(old, new.withColumn("seq", F.right("run_id", F.lit(1)).cast("int")), ["path"], "seq")


def claims(spark, d):
    c = G.claims(claim_docs(spark, d)).select("page_path", "statement", "status", F.concat(F.lit("kb://"), "page_path").alias("evidence"), F.lit("run-0").alias("run_id"))
    old = c.filter(F.length("statement") % 2 == 0).unionByName(c.withColumn("statement", F.concat(F.lit("old "), "statement")).filter(F.length("statement") % 3 == 0)).distinct()
    touched = T.docs(spark, d).filter(F.col("lang") == "en").select(F.col("path").alias("page_path"))
    new = c.join(touched, "page_path", "left_semi").withColumn("run_id", F.lit("run-1")).withColumn("seq", F.lit(1))
    return D.upsert_claims(old, new, touched)


_CLAIMS = """SELECT path AS page_path, substr(line, 3) AS statement, lang FROM
    (SELECT *, last_value(claim IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS inside FROM
      (SELECT *, CASE WHEN starts_with(line, '#') THEN contains(lower(line), 'claim') END AS claim FROM
        (SELECT m.path, d.lang, line_no, trim(CASE WHEN regexp_matches(line, '^## [A-M]') THEN '## Claims ' || substr(line, 4)
            WHEN line <> '' AND NOT regexp_matches(line, '^[#`]') THEN '- ' || line ELSE line END) AS line FROM f_md m JOIN f_docs d ON m.path = d.path)))
    WHERE inside AND starts_with(line, '- ') AND octet_length(encode(substr(line, 3))) >= 8"""


def replaced(spark, d):
    c = T.chunks(spark, d)
    touched = T.docs(spark, d).filter(F.col("lang") == "es").select(F.col("path").alias("page_path"))
    new = c.join(touched, "page_path", "left_semi").filter(F.col("ord") == 0).withColumn("source", F.lit("new"))
    return D.replace_by_page(c, new).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("end_line").alias("lines"))


def pruned(spark, d):
    p, c = T.docs(spark, d), T.chunks(spark, d)
    left = D.prune(p, c, I.gram_sets(c, "chunk_id", ["body"]), p.filter(F.col("lang") != "en"))
    return left[0].agg(F.count("*").alias("n")).withColumn("what", F.lit("pages")).unionByName(
        left[1].agg(F.count("*").alias("n")).withColumn("what", F.lit("chunks"))
    ).unionByName(left[2].agg(F.countDistinct("chunk_id").alias("n")).withColumn("what", F.lit("indexed chunks")))


def currency(spark, d):
    p = T.docs(spark, d)
    hashed = p.select("path", F.sha2("body", 256).alias("body_hash"))
    known = p.select("path", F.when(F.col("lang") == "de", F.lit("x")).otherwise(F.sha2("body", 256)).alias("body_hash"))
    c = T.chunks(spark, d).withColumn("source", F.when((F.col("ord") == 3), F.lit("structural|old")).otherwise(F.col("source")))
    return D.chunk_currency(hashed, known, c, "hybrid|512|llm=false")


def known_pages(spark, d):
    return T.docs(spark, d).filter(F.col("lang") == "fr").select("path", F.lit("T").alias("title"), F.lit("Module").alias("page_type"), F.lit("D").alias("description"), F.lit("E").alias("evidence_hash"))


def deepened(spark, d):
    p = T.docs(spark, d)
    drafts = p.select("path", "body", (F.col("n_chars") % 4).alias("gaps"))
    revised = p.filter(F.col("lang") != "es").select("path", F.concat("body", F.when(F.col("lang") == "en", "!").otherwise("")).alias("body"), (F.col("doc_id") % 4).alias("gaps"), (F.col("lang") == "fr").alias("polluted"))
    return D.better_of_two(drafts, revised).select("path", F.length("body").cast("bigint").alias("chars"), "revised")


def plan_pages(spark, d):
    return T.docs(spark, d).select("path", F.left("body", F.lit(12)).alias("title"), F.lit("Reference").alias("page_type"), F.col("lang").alias("description"), F.array("lang", "source").alias("tags"), "body")


def finalized(spark, d):
    pages = T.linked_docs(spark, d).withColumns({"title": F.col("path"), "description": F.lit("")})
    files = T.docs(spark, d).filter(F.col("lang") == "en")
    chunks = T.chunks(spark, d)
    f = N.finish_run(pages, chunks, I.gram_postings(chunks, "chunk_id", ["body"]), files, shared_dir(spark, "run"), "r1", "h1")
    row = lambda name, df, key, detail: df.select(F.lit(name).alias("frame"), key.alias("key"), detail.alias("detail"))
    out = row("pages", f["pages"], F.col("path"), F.sha2("body", 256)).unionByName(row("chunks", f["chunks"], F.col("chunk_id"), F.sha2("body", 256)))
    grams = f["postings"].groupBy("chunk_id").agg(F.sum("tf").alias("n"))
    out = out.unionByName(row("postings", grams, F.col("chunk_id"), F.col("n").cast("string"))).unionByName(row("index", f["index"], F.concat("grp", F.lit("|"), "pos"), F.col("line")))
    return out.unionByName(row("problems", f["problems"], F.concat("problem", F.lit("|"), "path"), F.col("detail")))


def second_run(spark, d):
    """A run and its mark, then the gate of the next one: nothing but own outputs changed, a page changed, another head, and no mark at all."""
    pages = T.linked_docs(spark, d).withColumns({"title": F.col("path"), "description": F.lit("")})
    chunks, path = T.chunks(spark, d), shared_dir(spark, "run")
    N.finish_run(pages, chunks, I.gram_postings(chunks, "chunk_id", ["body"]), T.docs(spark, d).filter(F.col("lang") == "en"), path, "r1", "h1")
    done = N.marks(spark, path)
    own = T.docs(spark, d).select(F.concat(F.lit(".corpus_kb/"), "path").alias("path"))
    case = lambda name, changed, finished, head: N.gate(changed, finished, F.lit(head)).withColumn("case", F.lit(name))
    out = case("same", own, done, "h1").unionByName(case("changed", own.unionByName(T.docs(spark, d).select("path")), done, "h1"))
    out = out.unionByName(case("head", own, done, "h2")).unionByName(case("none", own, done.filter("false"), "h1"))
    return out.withColumns({n: done.select(n).scalar() for n in ("pages", "chunks", "problems", "pruned")})


_SCOPED = """SELECT p.repo, p.path, p.scope, f.rel, f.language, f.size, row_number() OVER (PARTITION BY p.repo, p.path ORDER BY f.rel) AS by_name,
    row_number() OVER (PARTITION BY p.repo, p.path ORDER BY f.size DESC, f.rel) AS by_size
    FROM plan p JOIN txt f ON f.repo = p.repo AND f.language IS NOT NULL AND (p.scope = '' OR starts_with(f.rel, p.scope || '/'))"""
_OUTLINED = """SELECT repo, path, string_agg(line, '' ORDER BY by_size) AS t FROM
    (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY repo, path ORDER BY by_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM
      (SELECT s.repo, s.path, s.by_size, CASE WHEN d.decls IS NULL THEN concat('- `', s.rel, '` (', s.language, ')', chr(10)) ELSE concat('- `', s.rel, '` (', s.language, ', ', s.size, ' B): ', d.decls, chr(10)) END AS line
       FROM scoped s LEFT JOIN (SELECT rel, string_agg(concat('`', line, '` ', kind, ' ', name), ' · ' ORDER BY line) AS decls FROM decl WHERE rn <= 8 GROUP BY rel) d ON s.rel = d.rel WHERE by_size <= 14))
    WHERE used <= 4200 GROUP BY repo, path"""
_EVIDENCE = with_views(
    """SELECT p.repo, p.path, concat('Sources: ', f.n, '; written in ', CASE WHEN f.langs = '' THEN 'unknown' ELSE f.langs END, chr(10), chr(10), '# From the readme', chr(10), left(f.readme, 900), chr(10),
          chr(10), '# Manifests', chr(10), m.t, chr(10), '# Modules', chr(10), CASE WHEN f.n > 0 THEN concat('- ', p.repo, ' (`', p.repo, '` → `', p.repo, '/`) · ', f.n, ' files', chr(10)) ELSE '' END,
          chr(10), '# Planned pages', chr(10), l.t, chr(10), '# Files of the ', CASE WHEN p.scope = '' THEN 'repository' ELSE 'module' END, chr(10), coalesce(x.t, ''),
          chr(10), '# Declarations by line', chr(10), coalesce(o.t, '- none' || chr(10))) AS evidence
       FROM plan p JOIN facts f ON p.repo = f.repo JOIN (SELECT repo, string_agg(concat('- `', rel, '` · dep: ', lang, ', serde · package: ', repo, chr(10)), '' ORDER BY rel) AS t
          FROM (SELECT source AS repo, lang, concat(source, '/', doc_id, '/Cargo.toml') AS rel FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY rel) <= 12) GROUP BY repo) m ON m.repo = p.repo
       JOIN (SELECT repo, string_agg(concat('- [', title, '](', path, ') — d', chr(10)), '' ORDER BY path) AS t FROM plan GROUP BY repo) l ON p.repo = l.repo
       LEFT JOIN (SELECT repo, path, string_agg(CASE WHEN by_name = 61 THEN '- and more' || chr(10) ELSE concat('- ', rel, ' (', language, ', ', size, ' B)', chr(10)) END, '' ORDER BY by_name) AS t
                  FROM scoped WHERE by_name <= 61 GROUP BY repo, path) x ON x.repo = p.repo AND x.path = p.path
       LEFT JOIN outlined o ON o.repo = p.repo AND o.path = p.path""",
    txt="SELECT * FROM f_files",
    plan="SELECT DISTINCT repo, concat(repo, '/', split_part(rel, '/', 2), '.md') AS path, split_part(rel, '/', 2) AS title, CASE WHEN split_part(rel, '/', 2) <> 'en' THEN concat(repo, '/', split_part(rel, '/', 2)) ELSE '' END AS scope FROM txt",
    facts="SELECT repo, count(language) AS n, coalesce(array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ', '), '') AS langs, min(rel) AS readme FROM txt GROUP BY repo",
    decl=_DECL, scoped=_SCOPED, outlined=_OUTLINED,
)


def evidence(spark, d):
    """Evidence of one page per language folder and one per repository; sizes and hashes stand for the texts."""
    texts = T.source_texts(spark, d)
    plan = texts.select("repo", F.split_part("rel", F.lit("/"), F.lit(2)).alias("lang")).distinct().select(
        "repo", F.concat("repo", F.lit("/"), "lang", F.lit(".md")).alias("path"), F.col("lang").alias("title"), F.lit("d").alias("description"),
        F.when(F.col("lang") != "en", F.concat("repo", F.lit("/"), "lang")).alias("module"),
    )
    readmes = texts.groupBy("repo").agg(F.min("rel").alias("excerpt"))
    body = F.concat(F.lit('[package]\nname = "'), "source", F.lit('"\n\n[dependencies]\n'), "lang", F.lit(' = "1"\nserde = "1"\n'))
    manifests = T.table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/Cargo.toml")).alias("rel"), body.alias("text"))
    return E.evidence(plan, texts, readmes, E.BUDGET, manifests)


def claims_round_trip(spark, d):
    """Sidecars written as JSON and read back with the tolerant reader."""
    out = shared_dir(spark, "claims")
    K.write_claims(G.claims(claim_docs(spark, d)), out)
    return R.read_claims(spark, out).select("page_path", "statement", F.array_join("evidence", ",").alias("evidence"), "status")


def chunk_sink(spark, d):
    """Chunk table written by page bucket, then the buckets of one language's pages written again."""
    out, c = shared_dir(spark, "chunks"), T.chunks(spark, d)
    D.write_chunks_by_page(c, out, buckets=8)
    stored = spark.read.parquet(out)
    touched = T.docs(spark, d).filter(F.col("lang") == "es").select(F.col("path").alias("page_path"))
    bucket = F.pmod(F.xxhash64("page_path"), F.lit(8)).cast("int")
    hit = touched.select(bucket.alias("page_bucket")).distinct()
    whole = stored.join(hit, "page_bucket", "left_semi").drop("page_bucket")
    new = c.join(touched, "page_path", "left_semi").filter(F.col("ord") == 0).withColumn("source", F.lit("new"))
    from corpus_kb.session import materialize

    D.write_chunks_by_page(materialize(D.replace_by_page(whole, new), "touched"), out, buckets=8)
    return spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("end_line").alias("lines"))


ENTRIES = {
    "I5_run_finalisation": (
        finalized,
        with_views("""SELECT 'pages' AS frame, path AS key, sha256(linked) AS detail FROM kept
            UNION ALL SELECT 'chunks', chunk_id, sha256(body) FROM f_chunks WHERE page_path IN (SELECT path FROM kept)
            UNION ALL SELECT 'postings', chunk_id, cast(length(body) - 2 AS varchar) FROM f_chunks WHERE page_path IN (SELECT path FROM kept) AND length(body) > 2
            UNION ALL SELECT 'index', 'd|' || path, concat('- [', path, '](', path, ') — ') FROM kept UNION ALL SELECT DISTINCT 'index', 'd|', '## d' FROM kept
            UNION ALL SELECT 'problems', 'missing|' || v.p, '' FROM (VALUES ('index.md'), ('quickstart.md'), ('README.md')) v(p)
            UNION ALL SELECT 'problems', 'broken link|' || from_path, target FROM f_mdlinks WHERE from_path IN (SELECT path FROM kept) AND to_path NOT IN (SELECT path FROM kept)""",
            kept="SELECT d.path, concat('See [next](', target, '#top \"Next\").', chr(10), body) AS linked FROM f_docs d JOIN f_mdlinks l ON l.from_path = d.path WHERE lang = 'en'"),
    ),
    "I4_I5_second_run": (
        second_run,
        with_views("""SELECT * FROM (VALUES ('same', 0::bigint, true), ('changed', (SELECT count(*) FROM f_docs), false), ('head', 0::bigint, false), ('none', 0::bigint, false)) v("case", relevant, no_op),
            (SELECT count(*) FILTER (lang = 'en') AS pages, count(*) FILTER (lang <> 'en') AS pruned FROM f_docs),
            (SELECT count(*) AS chunks FROM f_cut WHERE page_path IN (SELECT path FROM f_docs WHERE lang = 'en')),
            (SELECT 3 + count(*) AS problems FROM f_mdlinks WHERE from_path IN (SELECT path FROM f_docs WHERE lang = 'en') AND to_path NOT IN (SELECT path FROM f_docs WHERE lang = 'en'))"""),
    ),
    "I6_evidence_bundle": (evidence, _EVIDENCE),
    "S8_claims_round_trip": (
        claims_round_trip,
        with_views("SELECT page_path, statement, concat('kb://', page_path) AS evidence, 'active' AS status FROM claims", claims=_CLAIMS),
    ),
    "K7_chunk_sink_by_bucket": (
        chunk_sink,
        with_views("""SELECT CASE WHEN lang = 'es' THEN 'new' ELSE 'structural|hybrid|512|llm=false' END AS source, count(*) AS chunks, sum(end_line)::bigint AS lines
            FROM f_cut c JOIN f_docs d ON c.page_path = d.path WHERE lang <> 'es' OR ord = 0 GROUP BY 1"""),
    ),
    "U2_upsert_pages": (
        page_versions,
        with_views("SELECT path, CASE WHEN lang IN ('de', 'fr') THEN 'h' ELSE sha256(body) END AS body_hash, CASE WHEN lang IN ('de', 'fr') THEN 'run-2' ELSE 'run-0' END AS run_id FROM f_docs"),
    ),
    "U5_upsert_claims": (
        claims,
        with_views("""SELECT page_path, statement, CASE WHEN lang <> 'en' THEN 'active' WHEN (page_path, statement) IN (SELECT (page_path, statement) FROM claims) THEN 'active' ELSE 'stale' END AS status,
            concat('kb://', page_path) AS evidence, CASE WHEN lang = 'en' AND (page_path, statement) IN (SELECT (page_path, statement) FROM claims) THEN 'run-1' ELSE 'run-0' END AS run_id FROM
            (SELECT DISTINCT page_path, statement, lang FROM (SELECT * FROM claims WHERE length(statement) % 2 = 0 OR lang = 'en' UNION ALL SELECT page_path, 'old ' || statement, lang FROM claims WHERE length('old ' || statement) % 3 = 0))""", claims=_CLAIMS),
    ),
    "K7_U6_J2_replace_chunks_by_page": (
        replaced,
        with_views("""SELECT CASE WHEN lang = 'es' THEN 'new' ELSE 'structural|hybrid|512|llm=false' END AS source, count(*) AS chunks, sum(end_line)::bigint AS lines
            FROM f_cut c JOIN f_docs d ON c.page_path = d.path WHERE lang <> 'es' OR ord = 0 GROUP BY 1"""),
    ),
    "J3_prune_missing_pages": (
        pruned,
        with_views("""SELECT count(*) AS n, 'pages' AS what FROM f_docs WHERE lang <> 'en' UNION ALL SELECT count(*), w FROM f_cut c JOIN f_docs d ON c.page_path = d.path, (VALUES ('chunks'), ('indexed chunks')) v(w) WHERE lang <> 'en' GROUP BY w"""),
    ),
    "J14_cascade_cleanup": (
        lambda s, d: D.drop_orphans(T.calls(s, d), T.runs(s, d).filter(F.col("status") != "failed"), "run_id", "run_id").groupBy("stage").agg(F.count("*").alias("calls")),
        with_views("SELECT stage, count(*) AS calls FROM f_calls WHERE run_id IN (SELECT run_id FROM f_runs WHERE status <> 'failed') GROUP BY stage"),
    ),
    "J17_index_disk_reconciliation": (
        lambda s, d: D.reconcile(T.docs(s, d).filter(F.col("lang") != "de"), T.docs(s, d).filter(F.col("lang") != "fr")),
        with_views("SELECT count(*) FILTER (lang IN ('en', 'es')) AS both, count(*) FILTER (lang = 'fr') AS index_only, count(*) FILTER (lang = 'de') AS disk_only FROM f_docs"),
    ),
    "U15_delete_pages": (
        lambda s, d: D.delete_pages(T.docs(s, d), T.docs(s, d).filter(F.col("n_chars") < 500)).select("path"),
        with_views("SELECT path FROM f_docs WHERE n_chars >= 500"),
    ),
    "I1_page_fingerprints": (
        lambda s, d: planned(s, d).select("path", "fingerprint"), with_views(_FP, digests=_DIGESTS),
    ),
    "J5_I2_P12_reuse_plan": (plan, with_views(_PLAN, digests=_DIGESTS, fp=_FP)),
    "I3_outcomes": (
        outcomes,
        with_views("""SELECT path, outcome, right(CASE WHEN outcome = 'template' THEN fingerprint || '+template' ELSE fingerprint END, 9) AS tail FROM
            (SELECT p.path, fingerprint, CASE WHEN action = 'reuse' THEN 'reused' WHEN lang <> 'fr' AND length(trim(body, chr(32)||chr(9)||chr(10)||chr(13))) >= 80 THEN 'generated' WHEN keep_on_failure THEN 'kept_previous' ELSE 'template' END AS outcome
             FROM plan p JOIN f_docs d ON p.path = d.path)""", digests=_DIGESTS, fp=_FP, plan=_PLAN),
    ),
    "I4_no_op_gate": (
        lambda s, d: D.is_no_op(T.docs(s, d).select(F.when(F.col("lang") == "en", F.col("path")).otherwise(F.concat(F.lit(".corpus_kb/"), "path")).alias("path")), F.lit("h"), F.lit("h")),
        with_views("SELECT count(*) FILTER (lang = 'en') AS relevant, count(*) FILTER (lang = 'en') = 0 AS no_op FROM f_docs"),
    ),
    "J6_chunk_currency": (
        currency,
        with_views("SELECT path, lang <> 'de' AND coalesce(n, 0) BETWEEN 1 AND 3 AS current FROM f_docs LEFT JOIN (SELECT page_path, count(*) AS n FROM f_cut GROUP BY page_path) ON page_path = path"),
    ),
    "A2_A3_chunk_counts": (
        lambda s, d: D.chunk_counts(T.chunks(s, d).withColumn("source", F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(F.lit("old"))), "hybrid|512|llm=false"),
        with_views("SELECT page_path, count(*) AS chunks, count(*) FILTER (ord % 2 = 0) AS current FROM f_cut GROUP BY page_path"),
    ),
    "U8_reindex": (
        lambda s, d: D.reindex_pages(heading_docs(s, d), known_pages(s, d)),
        with_views("""SELECT d.path, CASE WHEN lang = 'fr' THEN 'T' ELSE coalesce(h.title, d.path) END AS title, CASE WHEN lang = 'fr' THEN 'Module' ELSE 'Reference' END AS page_type,
            CASE WHEN lang = 'fr' THEN 'D' ELSE '' END AS description, sha256(t.body) AS body_hash, CASE WHEN lang = 'fr' THEN 'E' ELSE '' END AS evidence_hash
            FROM f_docs d JOIN (SELECT path, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS body FROM hd GROUP BY path) t ON d.path = t.path LEFT JOIN
            (SELECT path, arg_min(left(trim(substr(line, 3)), 120), line_no) AS title FROM hd WHERE NOT in_fence AND starts_with(trim(line), '# ') GROUP BY path) h ON d.path = h.path""",
            hd="SELECT path, line_no, in_fence, CASE WHEN regexp_matches(line, '^## [A-E]') THEN substr(line, 2) ELSE line END AS line FROM f_fence"),
    ),
    "U13_patch_text_all": (
        lambda s, d: D.patch_text(T.docs(s, d), "the ", "THE ").select("path", F.sha2("body", 256).alias("h"), "changes"),
        with_views("SELECT path, sha256(replace(body, 'the ', 'THE ')) AS h, (length(body) - length(replace(body, 'the ', ''))) // 4 AS changes FROM f_docs WHERE contains(body, 'the ')"),
    ),
    "U13_patch_text_first": (
        lambda s, d: D.patch_text(T.docs(s, d), "the ", "THE ", False).select("path", F.sha2("body", 256).alias("h"), "changes"),
        with_views("SELECT path, sha256(concat(left(body, strpos(body, 'the ') - 1), 'THE ', substr(body, strpos(body, 'the ') + 4))) AS h, 1::bigint AS changes FROM f_docs WHERE contains(body, 'the ')"),
    ),
    "U13_patch_lines": (
        lambda s, d: D.patch_lines(T.docs(s, d), 2, 3, "<cut>"),
        with_views("SELECT path, array_to_string(list_concat(l[1:1], ['<cut>'], l[4:]), chr(10)) AS body, least(len(l), 3) - 1 AS changes FROM (SELECT path, string_split(body, chr(10)) AS l FROM f_docs) WHERE len(l) >= 2"),
    ),
    "W17_insertion_order": (
        lambda s, d: D.insertion_order(T.docs(s, d).select("path", F.col("doc_id").alias("inserted"))),
        with_views("SELECT path, doc_id AS inserted FROM f_docs"),
    ),
    "W19_better_of_two_versions": (
        deepened,
        with_views("""SELECT path, length(body) + CASE WHEN rev AND lang = 'en' THEN 1 ELSE 0 END AS chars, rev AS revised FROM (SELECT *, lang NOT IN ('es', 'fr')
            AND length(trim(body || CASE WHEN lang = 'en' THEN '!' ELSE '' END, chr(32)||chr(9)||chr(10)||chr(13))) >= 80 AND (doc_id % 4 < n_chars % 4 OR (doc_id % 4 = n_chars % 4 AND lang = 'en')) AS rev FROM f_docs)"""),
    ),
    "K1_F11_page_sink": (
        lambda s, d: K.page_texts(plan_pages(s, d)),
        with_views("""SELECT path, concat('---', chr(10), 'description: ', lang, chr(10), 'tags: [', lang, ', ', source, ']', chr(10), 'title: ', left(body, 12), chr(10), 'type: Reference', chr(10), '---', chr(10),
            rtrim(ltrim(body, chr(10)), chr(32)||chr(9)||chr(10)||chr(13)), chr(10)) AS content FROM f_docs"""),
    ),
    "K2_claims_sidecar": (
        lambda s, d: K.claims_sidecars(G.claims(claim_docs(s, d))).select("file", "page", F.array_join(F.transform("claims", lambda c: c["statement"]), "|").alias("statements")),
        with_views("SELECT concat(replace(page_path, '/', '__'), '.json') AS file, page_path AS page, string_agg(statement, '|' ORDER BY line_no) AS statements FROM claims GROUP BY page_path",
            claims=_CLAIMS.replace("SELECT path AS page_path,", "SELECT path AS page_path, line_no,", 1)),
    ),
    "K4_index_page": (
        lambda s, d: K.index_lines(plan_pages(s, d).withColumn("path", F.when(F.col("path") == "d/src0/0.md", F.lit("quickstart.md")).otherwise(F.substring("path", 3, 1000)))),
        with_views("""SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS grp, path AS pos, concat('- [', left(body, 12), '](', path, ') — ', lang) AS line FROM p
            UNION ALL SELECT DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END, '', concat('## ', CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END) FROM p
            UNION ALL SELECT '', '', concat('**Start: [', left(body, 12), '](', path, ') — ', lang, '**') FROM p WHERE path = 'quickstart.md'""",
            p="SELECT CASE WHEN path = 'd/src0/0.md' THEN 'quickstart.md' ELSE substr(path, 3) END AS path, body, lang FROM f_docs"),
    ),
}

"""Index, ranking and recall queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.functions.terms import FILLER, SEPARATORS, match_expression, query_terms
from corpus_kb.operators import delta as D
from corpus_kb.operators import graph as G
from corpus_kb.operators import index as I
from corpus_kb.operators import recall as C
from corpus_kb.operators import search as S
from corpus_kb.operators import store as X
from corpus_kb.session import shared_dir
from corpus_kb.sources import tables as T

LIMIT = 10
MAX_TERMS = 16
_CLASS = "".join("\\" + c if ord(c) < 128 else c for c in SEPARATORS).replace("'", "''")

_TERMS = f"""SELECT query_id, pos - 1 AS pos, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM
    (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(k)) AS pos FROM
      (SELECT query_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS k FROM
        (SELECT query_id, regexp_split_to_array(translate(lower(query), '%"*''\\', ''), '[\\s{_CLASS}]+') AS tokens FROM questions))
      WHERE length(term) >= 2 GROUP BY query_id, term) WHERE pos <= 16"""

_ENT = "SELECT concat('ent_', left(sha256(canonical_key), 12)) AS id, kind, name, canonical_key, status FROM f_entities"

_MATCHES = """SELECT term, chunk_id, doc_len, contains(head, term) AS in_head,
    (length(head) - length(replace(head, term, ''))) // length(term) + (length(lbody) - length(replace(lbody, term, ''))) // length(term) AS tf
    FROM (SELECT DISTINCT term FROM terms) JOIN (SELECT chunk_id, lower(concat(title, chr(10), summary)) AS head, lower(body) AS lbody,
        greatest(length(title) - 2, 0) + greatest(length(summary) - 2, 0) + greatest(length(body) - 2, 0) AS doc_len FROM f_chunks)
    ON contains(head, term) OR contains(lbody, term)"""

_BM25 = f"""SELECT query_id, chunk_id, strength, 0.8 + 0.8 * (strength / (strength + 1.0)) AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, chunk_id) AS pos FROM
      (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS strength
       FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM matches WHERE length(term) >= 3) m JOIN terms t ON m.term = t.term,
         (SELECT count(*) AS n, avg(greatest(length(title) - 2, 0) + greatest(length(summary) - 2, 0) + greatest(length(body) - 2, 0)) AS avg_len FROM f_chunks)
       GROUP BY query_id, chunk_id)) WHERE pos <= {LIMIT}"""


def _like(terms: str) -> str:
    return f"""SELECT f.query_id, f.chunk_id, 0.75 + least(sum(CASE WHEN in_head THEN 0.1::double ELSE 0.05::double END), 0.4) AS score
        FROM (SELECT DISTINCT t.query_id, k.chunk_id FROM {terms} t JOIN
            (SELECT term, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY chunk_id) AS pos FROM matches) WHERE pos <= {LIMIT}) k ON t.term = k.term) f
        JOIN {terms} t ON t.query_id = f.query_id JOIN matches m ON m.term = t.term AND m.chunk_id = f.chunk_id GROUP BY f.query_id, f.chunk_id"""


_ENTITY_HITS = f"""SELECT DISTINCT query_id, id, kind FROM terms t JOIN
    (SELECT term, id, kind, row_number() OVER (PARTITION BY term ORDER BY id) AS pos FROM (SELECT DISTINCT term FROM terms)
     JOIN ent ON status = 'active' AND (contains(lower(name), term) OR contains(lower(canonical_key), term))) e ON t.term = e.term WHERE e.pos <= {LIMIT}"""

_HITS = f"""SELECT query_id, pos, kind, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, step, id) AS pos FROM
    (SELECT query_id, kind, id, step, score, round(score + CASE WHEN kind = 'chunk' THEN 0.35 ELSE 0 END, 9) AS rank FROM
      (SELECT query_id, kind, id, 0 AS step, 1.0::double AS score FROM entity_hits
       UNION ALL SELECT query_id, 'chunk', chunk_id, 1, score FROM bm25
       UNION ALL SELECT query_id, 'chunk', chunk_id, 2, score FROM lk WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM bm25))))
    WHERE pos <= {LIMIT}"""


def _parts(questions: str) -> dict[str, str]:
    return {
        "questions": questions, "terms": _TERMS, "ent": _ENT, "matches": _MATCHES, "bm25": _BM25,
        "like_terms": "SELECT * FROM terms WHERE query_id NOT IN (SELECT query_id FROM bm25) OR length(term) < 3",
        "lk": _like("like_terms"), "entity_hits": _ENTITY_HITS, "hits": _HITS,
        "detailed": """SELECT h.*, coalesce(c.title, e.name) AS title, coalesce(c.summary, e.canonical_key) AS summary, c.page_path, c.body, c.start_line, c.end_line
            FROM hits h LEFT JOIN f_chunks c ON h.id = c.chunk_id LEFT JOIN ent e ON h.id = e.id""",
    }


_BENCH = _parts("SELECT * FROM f_bench")
_CHAT = _parts("SELECT * FROM (SELECT conv_id AS query_id, arg_max(text, turn) AS query FROM f_conv WHERE role = 'user' GROUP BY conv_id) WHERE trim(query) <> ''")


def _sql(body: str, parts: dict[str, str], *names: str) -> str:
    return with_views(body, **{n: parts[n] for n in names})


_UP_TO_TERMS = ("questions", "terms")
_UP_TO_MATCHES = (*_UP_TO_TERMS, "matches")
_UP_TO_BM25 = (*_UP_TO_MATCHES, "bm25")
_UP_TO_HITS = (*_UP_TO_TERMS, "ent", "matches", "bm25", "like_terms", "lk", "entity_hits", "hits")
_ALL = (*_UP_TO_HITS, "detailed")


def entities(spark, d):
    e = T.entities(spark, d)
    return e.select(F.concat(F.lit("ent_"), F.left(F.sha2("canonical_key", 256), F.lit(12))).alias("id"), "kind", "name", "canonical_key", "status")


def bm25(spark, d):
    terms = S.query_terms(T.questions(spark, d), max_terms=MAX_TERMS)
    found = S.bm25_by_scan(terms, T.chunks(spark, d), "chunk_id", ["title", "summary"], ["body"], LIMIT)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def substring(spark, d):
    terms = S.query_terms(T.questions(spark, d), max_terms=MAX_TERMS)
    found = S.substring_by_scan(terms, T.chunks(spark, d), "chunk_id", ["title", "summary"], ["body"], LIMIT)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def hits(spark, d):
    return S.search(T.questions(spark, d), T.chunks(spark, d), entities(spark, d), LIMIT, max_terms=MAX_TERMS, per_term=LIMIT)


def fused(spark, d):
    return hits(spark, d).select("query_id", "pos", "kind", "id", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"))


def like_mode(spark, d):
    found = S.search(T.questions(spark, d), T.chunks(spark, d), limit=LIMIT, mode="like", max_terms=MAX_TERMS, per_term=LIMIT)
    return found.select("query_id", "pos", "id", F.round("score", 6).alias("score"))


def chat(spark, d):
    asked = C.latest_questions(T.turns(spark, d))
    found = S.search(asked, T.chunks(spark, d), entities(spark, d), LIMIT, max_terms=MAX_TERMS, per_term=LIMIT)
    return C.answers(asked, found)


def index_gap(spark, d):
    """Index built before the documents of one language arrived; the rest is found and counted."""
    chunks = T.chunks(spark, d)
    known = chunks.join(T.docs(spark, d).filter(F.col("lang") == "en").select(F.col("path").alias("page_path")), "page_path", "left_semi")
    postings = I.gram_postings(known, "chunk_id", S.CHUNK_TEXT, marks=True)
    return I.missing_from_index(chunks, postings, "chunk_id").select("chunk_id")


def index_backfill(spark, d):
    """An index that lacks most languages and still holds one that is gone: after the backfill it equals a new one."""
    chunks = T.chunks(spark, d)
    of = lambda *langs: T.docs(spark, d).filter(F.col("lang").isin(*langs)).select(F.col("path").alias("page_path"))
    old = I.gram_postings(chunks.join(of("en", "fr"), "page_path", "left_semi"), "chunk_id", S.CHUNK_TEXT)
    return I.gram_statistics(I.backfill(chunks.join(of("fr"), "page_path", "left_anti"), old, "chunk_id", S.CHUNK_TEXT))


def replaced_pages(spark, d):
    """Pages of one language replaced by their first chunk, those of another deleted: chunks, postings and mentions follow together."""
    chunks = T.chunks(spark, d)
    of = lambda *langs: T.docs(spark, d).filter(F.col("lang").isin(*langs)).select(F.col("path").alias("page_path"))
    index = lambda c: I.gram_postings(c, "chunk_id", S.CHUNK_TEXT)
    names = spark.createDataFrame([("w:que", "que"), ("w:the", "the")], "id string, name string").withColumns(
        {"kind": F.lit("word"), "canonical_key": F.col("id"), "status": F.lit("active")})
    mention = lambda c: G.chunk_mentions(c, names)
    new = chunks.join(of("es"), "page_path", "left_semi").filter(F.col("ord") == 0).withColumn("source", F.lit("new")).withColumn("chunk_id", F.concat("chunk_id", F.lit("_2")))
    c, p, m = D.replace_pages(chunks, index(chunks), mention(chunks), new, of("es", "de"), index, mention)
    size = lambda df, what, total: df.agg(F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("chunks"), F.sum(total).cast("bigint").alias("total")).withColumn("what", F.lit(what))
    return size(c, "chunks", "end_line").unionByName(size(p, "postings", "tf")).unionByName(size(m, "mentions", "mentions"))


def new_store(spark):
    return X.create(X.IndexStore(spark, shared_dir(spark, "index"), tuple(S.CHUNK_TEXT), buckets=16))


def index_segments(spark, d):
    """Four batches into a stored index and a merge: English and French pages come first, then Spanish ones, French ones are cut to their first chunk, German ones deleted."""
    chunks = T.chunks(spark, d)
    of = lambda *langs: T.docs(spark, d).filter(F.col("lang").isin(*langs)).select(F.col("path").alias("page_path"))
    mine = lambda *langs: chunks.join(of(*langs), "page_path", "left_semi")
    store = new_store(spark)
    X.add(store, mine("en", "fr", "de"))
    X.add(store, mine("es"))
    X.replace(store, of("fr"), mine("fr").filter(F.col("ord") == 0))
    X.replace(store, of("de"), chunks.limit(0))
    X.merge(store, factor=2)
    return store.postings().groupBy("gram").agg(F.count("*").alias("df"))


def stored_index(spark, d):
    """Search over a stored index: rarest grams from its dictionary, then the buckets that hold them."""
    chunks = T.chunks(spark, d)
    store = new_store(spark)
    X.add(store, chunks)
    found = S.search(T.questions(spark, d), chunks, entities(spark, d), LIMIT, store=store, max_terms=MAX_TERMS, per_term=LIMIT)
    return found.select("query_id", "pos", "kind", "id", F.round("score", 6).alias("score"))


_GRAMS = """SELECT gram, chunk_id, count(*) AS tf FROM (SELECT chunk_id, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram
    FROM (SELECT chunk_id, lower(unnest([title, summary, body])) AS t FROM f_chunks)) GROUP BY gram, chunk_id"""

# fixed value: "how are database indexes built and queried", without spaces
_RUN = "数据库索引怎么构建查询"
_KNOWN = ", ".join(f"'{w}'" for w in FILLER)


def cjk_questions(spark, d):
    """Questions that open with a run of 5 to 10 characters without spaces."""
    q = T.questions(spark, d)
    return q.select("query_id", F.concat(F.left(F.lit(_RUN), (5 + F.col("query_id") % 6).cast("int")), F.lit(" "), "query").alias("query"))


def _run_windows(n: int, quota: int) -> str:
    return f"list_filter(list_transform(range(1, length(s) - {n - 2}), lambda i: substr(s, i::int, {n})), lambda w: w NOT IN ({_KNOWN}))[:{quota}]"


_CJK_TERMS = f"""SELECT query_id, pos - 1 AS pos, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM
    (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(k)) AS pos FROM
      (SELECT query_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS k FROM
        (SELECT query_id, list_concat({_run_windows(4, 4)}, {_run_windows(3, 4)}, {_run_windows(2, 10)},
            regexp_split_to_array(translate(lower(query), '%"*''\\', ''), '[\\s{_CLASS}]+')) AS tokens FROM (SELECT *, left('{_RUN}', (5 + query_id % 6)::int) AS s FROM questions)))
      WHERE length(term) >= 2 GROUP BY query_id, term)"""

ENTRIES = {
    "F23_cjk_query_terms": (lambda s, d: S.query_terms(cjk_questions(s, d)), with_views(_CJK_TERMS, questions="SELECT * FROM f_bench")),
    "F7_query_terms": (
        lambda s, d: S.query_terms(T.questions(s, d), max_terms=MAX_TERMS), _sql("SELECT * FROM terms", _BENCH, *_UP_TO_TERMS),
    ),
    "F8_match_expression": (
        lambda s, d: T.questions(s, d).select("query_id", match_expression(query_terms(F.col("query"), max_terms=MAX_TERMS)).alias("expression")),
        _sql("""SELECT query_id, coalesce(string_agg('"' || term || '"', ' OR ' ORDER BY pos) FILTER (length(term) >= 3), '') AS expression FROM terms GROUP BY query_id""", _BENCH, *_UP_TO_TERMS),
    ),
    "R1_trigram_index": (
        lambda s, d: I.gram_statistics(I.gram_postings(T.chunks(s, d), "chunk_id", S.CHUNK_TEXT)),
        with_views("SELECT gram, count(*) AS df, sum(tf)::bigint AS total FROM grams GROUP BY gram", grams=_GRAMS),
    ),
    "R1_postings": (
        lambda s, d: I.gram_postings(T.chunks(s, d), "chunk_id", S.CHUNK_TEXT).groupBy("chunk_id").agg(F.count("*").alias("grams"), F.sum("tf").alias("length"), F.max("tf").alias("max_tf")),
        with_views("SELECT chunk_id, count(*) AS grams, sum(tf)::bigint AS length, max(tf) AS max_tf FROM grams GROUP BY chunk_id", grams=_GRAMS),
    ),
    "R3_word_index": (
        lambda s, d: I.gram_statistics(I.word_postings(T.chunks(s, d), "chunk_id", S.CHUNK_TEXT), "word"),
        with_views("""SELECT word, count(DISTINCT chunk_id) AS df, count(*) AS total FROM
            (SELECT chunk_id, unnest(regexp_split_to_array(lower(t), '[^\\pL\\pN]+')) AS word FROM (SELECT chunk_id, unnest([title, summary, body]) AS t FROM f_chunks)) WHERE word <> '' GROUP BY word"""),
    ),
    "J1_R2_L5_bm25_search": (
        bm25, _sql("SELECT query_id, chunk_id, round(score, 6) AS score FROM bm25", _BENCH, *_UP_TO_BM25),
    ),
    "J10_R4_L6_substring_search": (
        substring, with_views("SELECT query_id, chunk_id, round(score, 6) AS score FROM lk", **{n: _BENCH[n] for n in _UP_TO_MATCHES}, lk=_like("terms")),
    ),
    "J11_entity_match": (
        lambda s, d: S.entity_hits(S.query_terms(T.questions(s, d), max_terms=MAX_TERMS), entities(s, d), LIMIT).select("query_id", "id", "kind"),
        _sql("SELECT query_id, id, kind FROM entity_hits", _BENCH, "questions", "terms", "ent", "entity_hits"),
    ),
    "R5_R6_L7_U1_J8_fused_search": (
        fused, _sql("SELECT query_id, pos, kind, id, round(score, 6) AS score, round(rank, 6) AS rank FROM hits", _BENCH, *_UP_TO_HITS),
    ),
    "R5_like_mode_search": (
        like_mode,
        with_views(
            f"""SELECT query_id, pos, id, round(score, 6) AS score FROM (SELECT query_id, chunk_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.35, 9) DESC, chunk_id) AS pos FROM lk)
            WHERE pos <= {LIMIT}""", **{n: _BENCH[n] for n in _UP_TO_MATCHES}, lk=_like("terms")),
    ),
    "R1_R5_stored_index_search": (
        stored_index, _sql("SELECT query_id, pos, kind, id, round(score, 6) AS score FROM hits", _BENCH, *_UP_TO_HITS),
    ),
    "U7_K7_U6_index_segments": (
        index_segments,
        with_views("""SELECT gram, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram
            FROM (SELECT chunk_id, concat(lower(unnest([coalesce(title, ''), coalesce(summary, ''), coalesce(body, '')])), chr(0), chr(0)) AS t FROM now)) GROUP BY gram""",
            now="SELECT c.* FROM f_chunks c JOIN f_docs d ON c.page_path = d.path WHERE d.lang IN ('en', 'es') OR (d.lang = 'fr' AND c.ord = 0)"),
    ),
    "U7_index_backfill": (
        index_gap, with_views("SELECT chunk_id FROM f_chunks c JOIN f_docs d ON c.page_path = d.path WHERE d.lang <> 'en'"),
    ),
    "U7_index_backfill_written": (
        index_backfill,
        with_views("SELECT gram, count(*) AS df, sum(tf)::bigint AS total FROM grams WHERE chunk_id NOT IN (SELECT chunk_id FROM f_chunks c JOIN f_docs d ON c.page_path = d.path WHERE d.lang = 'fr') GROUP BY gram", grams=_GRAMS),
    ),
    "J2_U6_replaced_pages_with_index": (
        replaced_pages,
        with_views("""SELECT 'chunks' AS what, count(*) AS rows, count(DISTINCT chunk_id) AS chunks, sum(end_line)::bigint AS total FROM now
            UNION ALL SELECT 'postings', count(*), count(DISTINCT g.chunk_id), sum(tf)::bigint FROM grams g JOIN now USING (chunk_id)
            UNION ALL SELECT 'mentions', count(*), count(DISTINCT chunk_id), sum(n)::bigint FROM
              (SELECT chunk_id, (length(h) - length(replace(h, w, ''))) // 3 + (length(b) - length(replace(b, w, ''))) // 3 AS n
               FROM (SELECT chunk_id, lower(concat(title, chr(10), summary)) AS h, lower(body) AS b FROM now) t, (VALUES ('que'), ('the')) v(w) WHERE contains(h, w) OR contains(b, w))""",
            grams=_GRAMS, now="SELECT c.* FROM f_chunks c JOIN f_docs d ON c.page_path = d.path WHERE d.lang <> 'de' AND (d.lang <> 'es' OR c.ord = 0)"),
    ),
    "R7_context_assembly": (
        lambda s, d: C.contexts(hits(s, d), C.EXCERPT_CHARS),
        _sql("""SELECT query_id, string_agg(concat('### [', pos, '] ', kind, ' · ', CASE WHEN page_path IS NULL THEN '(repository graph)' ELSE concat(page_path, ':', start_line, '-', end_line) END,
            chr(10), 'Title: ', title, chr(10), 'Summary: ', summary, chr(10), CASE WHEN body IS NULL THEN '' ELSE concat('Content:', chr(10), left(body, 2400), chr(10)) END, chr(10)), '' ORDER BY pos) AS context
            FROM detailed GROUP BY query_id""", _BENCH, *_ALL),
    ),
    "R8_R10_recalled_answers": (
        chat,
        _sql("""SELECT q.query_id, concat('**Results from the knowledge base** (no model answer; question: ', q.query, ').', chr(10), chr(10), coalesce('### Material' || chr(10) || chr(10) || t,
            'Nothing matches. Index more documents or use shorter keywords.' || chr(10))) AS answer FROM questions q LEFT JOIN
            (SELECT query_id, string_agg(concat(pos, '. **', title, '**', CASE WHEN page_path IS NULL THEN '' ELSE concat(' · `', page_path, '`') END, chr(10),
               CASE WHEN trim(summary) = '' THEN '' ELSE concat('   ', replace(trim(summary), chr(10), ' '), chr(10)) END, chr(10)), '' ORDER BY pos) AS t FROM detailed GROUP BY query_id) a ON q.query_id = a.query_id""", _CHAT, *_ALL),
    ),
    "R9_sources": (
        lambda s, d: C.sources(hits(s, d)).withColumn("score", F.round("score", 6)),
        _sql("SELECT query_id, pos, kind, id, title, summary, page_path, round(score, 6) AS score FROM detailed", _BENCH, *_ALL),
    ),
    "K6_F14_hits_json": (
        lambda s, d: C.hits_json(hits(s, d), ("kind", "id", "title", "summary", "page_path", "body", "start_line", "end_line")),
        _sql("""SELECT query_id, pos, concat('{"kind":', to_json(kind), ',"id":', to_json(id), ',"title":', to_json(title), ',"summary":', to_json(summary),
            CASE WHEN page_path IS NULL THEN '' ELSE concat(',"page_path":', to_json(page_path)) END, CASE WHEN body IS NULL THEN '' ELSE concat(',"body":', to_json(body)) END,
            CASE WHEN start_line IS NULL THEN '' ELSE concat(',"start_line":', start_line, ',"end_line":', end_line) END, '}') AS json FROM detailed""", _BENCH, *_ALL),
    ),
    "R10_latest_question": (
        lambda s, d: C.latest_questions(T.turns(s, d)),
        with_views("SELECT * FROM (SELECT conv_id AS query_id, max(turn) AS turn, arg_max(text, turn) AS query FROM f_conv WHERE role = 'user' GROUP BY conv_id) WHERE trim(query) <> ''"),
    ),
    "R11_history": (
        lambda s, d: C.history(T.turns(s, d)),
        with_views("SELECT conv_id, turn, concat(role, ': ', text) AS line FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM f_conv) WHERE turn < last"),
    ),
    "R12_L4_page_chunks": (
        lambda s, d: C.page_chunks(T.chunks(s, d), "d/src3/3.md").select("ord", "chunk_id", "title", "start_line", "end_line"),
        with_views("SELECT ord, chunk_id, title, start_line, end_line FROM f_chunks WHERE page_path = 'd/src3/3.md'"),
    ),
}

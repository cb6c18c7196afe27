"""Ranked retrieval for whole tables of queries.

Terms meet texts through one anchor gram each (equi-join on the gram), and every candidate is verified
against its text. No term-by-text product is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpus_kb.functions import terms as Q
from corpus_kb.operators import lookup
from corpus_kb.operators.index import GRAM, doc_length, gram_sets
from corpus_kb.operators.lookup import SEPARATORS
from corpus_kb.operators.store import IndexStore, candidates, narrowed
from corpus_kb.session import materialize

# fixed values
CHUNK_BONUS = 0.35
SYMBOL_MALUS = 0.15
ENTITY_SCORE = 1.0
HEAD_BOOST, BODY_BOOST = 0.1, 0.05
CHUNK_TEXT = ["title", "summary", "body"]
ENTITY_TEXT = ["name", "canonical_key"]
MODES = ("auto", "fts5", "like")
# terms are at most a few hundred bytes each, so a broadcast dictionary stays in the tens of megabytes
MAX_BROADCAST_TERMS = 100_000
# hits of queries, some 200 bytes each: within this bound they go to the texts, beyond it both sides are shuffled
MAX_BROADCAST_HITS = 200_000
# scores are rounded to nine digits; bounds keep well clear of that
MARGIN = 1e-6


def query_terms(queries: DataFrame, compat: bool = False, max_terms: int | None = None) -> DataFrame:
    """``query_id, pos, term, n_terms`` for a table ``query_id, query``."""
    split = queries.select("query_id", Q.query_terms(F.col("query"), compat, max_terms).alias("terms"))
    return split.select("query_id", F.size("terms").cast("bigint").alias("n_terms"), F.posexplode("terms").alias("pos", "term")).select(
        "query_id", F.col("pos").cast("bigint").alias("pos"), "term", "n_terms"
    )


def anchors(dictionary: DataFrame, postings: DataFrame) -> DataFrame:
    """Grams through which each term is looked up: ``term, gram``.

    A term of three or more characters uses its rarest gram, so frequent grams seldom enter the join.
    A shorter term uses every indexed gram it is a prefix of. Both meet the gram vocabulary, counted
    once with map-side combine, by equality on a probe string.
    """
    probes = F.when(F.length("term") >= GRAM, F.array_distinct(Q.ngrams(F.col("term"), GRAM))).otherwise(F.array("term"))
    wanted = dictionary.select("term", F.explode(probes).alias("probe"))
    vocabulary = postings.groupBy("gram").agg(F.count("*").alias("df"))
    keys = F.array("gram", F.left("gram", F.lit(2)), F.left("gram", F.lit(1)))
    found = wanted.join(vocabulary.select("gram", "df", F.explode(keys).alias("probe")), "probe")
    by_rarity = W.partitionBy("term").orderBy("df", "gram")
    return (
        found.withColumn("pos", F.row_number().over(by_rarity))
        .filter((F.length("term") < GRAM) | (F.col("pos") == 1)).select("term", "gram")
    )


def search_texts(items: DataFrame, id_col: str, head: list[str], body: list[str]) -> DataFrame:
    """``id, doc_len, _head, _text`` with both texts lower-cased; ``_text`` holds head and body."""
    return items.select(
        id_col, doc_length(head + body).alias("doc_len"), F.lower(F.concat_ws("\n", *head)).alias("_head"),
        F.lower(F.concat_ws("\n", *head, *body)).alias("_text"),
    )


def _verified(candidates: DataFrame, id_col: str) -> DataFrame:
    text, term = F.col("_text"), F.col("term")
    found = candidates.filter(F.contains(text, term))
    # only terms of indexable length are weighted by their count
    count = F.when(F.length(term) >= GRAM, Q.occurrences(text, term)).otherwise(F.lit(1))
    return found.select("term", id_col, "doc_len", F.contains("_head", term).alias("in_head"), count.cast("bigint").alias("tf"))


def _match_by_scan(dictionary: DataFrame, shortest: int, texts: DataFrame, id_col: str) -> DataFrame:
    """One pass over the texts and no shuffle: each text's distinct grams probe a broadcast dictionary.

    A long term is keyed by the one of its grams that fewest other terms share, a short one by itself.
    Explode, probe and verification run in one generated loop, so texts are not copied per gram.
    """
    probes = F.when(F.length("term") >= GRAM, F.array_distinct(Q.ngrams(F.col("term"), GRAM))).otherwise(F.array("term"))
    keyed = dictionary.select("term", F.explode(probes).alias("gram"))
    shared = keyed.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = keyed.join(shared, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    grams = F.array_distinct(F.concat(*[Q.ngrams(F.col("_text"), n) for n in range(max(1, min(shortest, GRAM)), GRAM + 1)]))
    return _verified(texts.withColumn("gram", F.explode(grams)).join(F.broadcast(chosen), "gram"), id_col)


def _match_by_index(dictionary: DataFrame, index: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """Candidates from the gram index, then their texts. For stored indexes and dictionaries of any size."""
    candidates = index.join(anchors(dictionary, index), "gram").select("term", id_col).distinct()
    return _verified(candidates.join(texts, id_col), id_col)


def _match_by_words(dictionary: DataFrame, match: Callable[[DataFrame, DataFrame, str], DataFrame], texts: DataFrame, id_col: str) -> DataFrame:
    """Terms meet the distinct words of all texts, and texts meet the words found: no text is searched for a term.

    A term of letters and digits lies inside one run of them, so it occurs in a text where it occurs in the text's words, as often as in all of
    them together. Words are written once; the vocabulary is counted with map-side combine, and ``match`` is asked about it alone.
    """
    def words(text: str, in_head: bool) -> Column:
        runs = F.filter(F.split(F.col(text), SEPARATORS), lambda w: w != "")
        return F.transform(runs, lambda w: F.struct(w.alias("word"), F.lit(in_head).alias("in_head")))

    held = materialize(texts.select(
        F.monotonically_increasing_id().alias("_row"), id_col, "doc_len", words("_head", True).alias("_head"), words("_text", False).alias("_text")), "words")
    vocabulary = held.select(F.explode("_text").alias("w")).select(F.col("w.word").alias("word")).distinct()
    as_texts = vocabulary.select("word", F.lit(0).cast("bigint").alias("doc_len"), F.lit("").alias("_head"), F.col("word").alias("_text"))
    known = materialize(match(dictionary, as_texts, "word").select("word", "term", "tf"), "found_words")
    placed = held.select("_row", id_col, "doc_len", F.explode(F.concat("_head", "_text")).alias("w")).select("_row", id_col, "doc_len", "w.*")
    # words of the head stand in the text as well, so only those of the text count
    times = F.sum(F.when(F.col("in_head"), 0).otherwise(F.col("tf")))
    # all of an item in the key: values of fixed width are aggregated by hash, strings would be sorted
    return placed.join(known, "word").groupBy("_row", id_col, "doc_len", "term").agg(F.max("in_head").alias("in_head"), times.alias("_times")).select("term", id_col, "doc_len", "in_head", F.when(F.length("term") >= GRAM, F.col("_times")).otherwise(1).cast("bigint").alias("tf"))


def match_terms(
    dictionary: DataFrame, items: DataFrame, id_col: str, head: list[str], body: list[str], postings: DataFrame | None = None,
    max_broadcast_terms: int = MAX_BROADCAST_TERMS, store: IndexStore | None = None, by_words: bool = False,
) -> DataFrame:
    """Every (term, item) with the term as a substring: ``term, id, doc_len, in_head, tf``.

    ``store`` is a stored index of the items, of which only the buckets that the terms need are read; ``postings`` is a :func:`gram_sets`
    index that is read whole. Without one, a dictionary whose counted size is within ``max_broadcast_terms`` is matched in a single scan; a
    larger one goes through grams derived from the items. ``by_words`` looks terms of letters and digits up in the items' distinct
    words instead of the items: one exchange of the matches, but no text is searched, which pays for many terms.
    """
    texts = search_texts(items, id_col, head, body)
    if store is not None:
        return _verified(candidates(store, dictionary).join(texts, id_col), id_col)
    if postings is not None:
        return _match_by_index(dictionary, postings, texts, id_col)
    plain = ~F.col("term").rlike(SEPARATORS) & F.lit(by_words)
    size = dictionary.agg(F.count("*").alias("n"), F.count_if(plain).alias("plain"), F.min(F.length("term")).alias("shortest")).first()

    def match(dictionary: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
        if size["n"] <= max_broadcast_terms:
            return _match_by_scan(dictionary, size["shortest"] or GRAM, texts, id_col)
        return _match_by_index(dictionary, gram_sets(texts, id_col, ["_text"]), texts, id_col)

    parts = [_match_by_words(dictionary.filter(plain), match, texts, id_col)] if size["plain"] else []
    if size["plain"] < size["n"] or not parts:
        parts.append(match(dictionary.filter(~plain) if parts else dictionary, texts, id_col))
    return reduce(DataFrame.unionByName, parts)


def bm25_hits(terms: DataFrame, matches: DataFrame, items: DataFrame, id_col: str, columns: list[str], limit: int) -> DataFrame:
    """Best ``limit`` items per query by BM25 over terms of three or more characters: ``query_id, id, strength, score``.

    Exact without scoring every (query, item) pair. The rarest terms of a query alone give a score that its ``limit``-th best item
    reaches for certain. Frequent terms whose greatest possible weights together stay below that score cannot bring a
    new item into the result: items come from the other terms only, those that cannot reach the score even with every frequent
    term are dropped, and the frequent terms are looked up for what is left.
    """
    stats = items.agg(F.count("*").alias("n"), F.avg(doc_length(columns)).alias("avg_len"))
    n_docs, avg_len = stats.select("n").scalar(), stats.select("avg_len").scalar()
    long_matches = matches.filter(F.length("term") >= GRAM).select("term", id_col, "tf", "doc_len")
    df = long_matches.groupBy("term").agg(F.count("*").alias("df"))
    weighted = df.join(terms.select("term", "query_id"), "term").withColumn("idf", Q.bm25_idf(n_docs, F.col("df"))).withColumn("most", F.col("idf") * (Q.K1 + 1))
    rare_first = W.partitionBy("query_id").orderBy("df", "term")
    weighted = materialize(weighted.withColumn("before", F.coalesce(F.sum("df").over(rare_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "terms")
    weight = Q.bm25_weight(F.col("idf"), F.col("tf"), F.col("doc_len"), avg_len)

    def scored(chosen: DataFrame) -> DataFrame:
        return long_matches.join(chosen, "term").groupBy("query_id", id_col).agg(F.sum(weight).alias("part"))

    by_part = W.partitionBy("query_id").orderBy(F.desc("part"), id_col)
    lead = scored(weighted.filter(F.col("before") < limit).select("query_id", "term", "idf"))
    reached = lead.withColumn("pos", F.row_number().over(by_part)).filter(F.col("pos") == limit).select("query_id", (F.col("part") - MARGIN).alias("floor"))
    weak_first = W.partitionBy("query_id").orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    split = materialize(weighted.join(reached, "query_id", "left").withColumn("sum", F.sum("most").over(weak_first)).withColumn(
        "frequent", F.coalesce(F.col("sum") < F.col("floor"), F.lit(False))), "terms")
    bounds = split.groupBy("query_id").agg(F.max("floor").alias("floor"), F.sum(F.when(F.col("frequent"), F.col("most")).otherwise(0.0)).alias("rest"))
    found = scored(split.filter(~F.col("frequent")).select("query_id", "term", "idf")).join(bounds, "query_id")
    candidates = materialize(found.filter(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor"))).select("query_id", id_col, "part"), "candidates")
    wanted = candidates.select("query_id", id_col).join(split.filter("frequent").select("query_id", "term", "idf"), "query_id")
    added = wanted.join(long_matches, ["term", id_col]).groupBy("query_id", id_col).agg(F.sum(weight).alias("more"))
    strength = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), Q.SCORE_DIGITS)
    best = W.partitionBy("query_id").orderBy(F.desc("strength"), id_col)
    return (
        candidates.join(added, ["query_id", id_col], "left").withColumn("strength", strength)
        .withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= limit)
        .select("query_id", id_col, "strength", Q.squash(F.col("strength")).alias("score"))
    )


def bm25_by_scan(terms: DataFrame, items: DataFrame, id_col: str, head: list[str], body: list[str], limit: int, among: DataFrame | None = None) -> DataFrame:
    """The result of :func:`bm25_hits` in two passes over the items: counts of terms, then each task's best items of each query.

    Matches stay in the task that found them, so nothing that grows with the number of matches is shuffled or written. ``among`` holds the
    items that may match where that is known; the others count for the statistics alone.
    """
    texts = search_texts(items if among is None else among, id_col, head, body)
    long_terms = terms.filter(F.length("term") >= GRAM)
    df = materialize(lookup.frequencies(texts, long_terms.select("term").distinct()), "frequencies")
    stats = items.agg(F.count("*").alias("n"), F.avg(doc_length(head + body)).alias("avg_len")).first()
    weighted = long_terms.join(df, "term").select("query_id", "term", Q.bm25_idf(F.lit(stats["n"]), F.col("df")).alias("idf"))
    best = W.partitionBy("query_id").orderBy(F.desc("strength"), id_col)
    found = lookup.best_items(texts, materialize(weighted, "weighted"), id_col, stats["avg_len"] or 1.0, limit)
    return (
        found.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= limit)
        .select("query_id", id_col, "strength", Q.squash(F.col("strength")).alias("score"))
    )


def substring_by_scan(terms: DataFrame, items: DataFrame, id_col: str, head: list[str], body: list[str], per_term: int | None = None) -> DataFrame:
    """The result of :func:`substring_hits`; with ``per_term`` only the items that some term adds are searched for all terms."""
    texts, dictionary = search_texts(items, id_col, head, body), materialize(terms.select("term").distinct(), "dictionary")
    if dictionary.isEmpty():
        return terms.select("query_id", F.lit(None).cast("string").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    if per_term is None:
        return substring_hits(terms, materialize(lookup.matches(texts, dictionary, id_col), "matches"), id_col)
    first = materialize(first_matches(lookup.first_items(texts, dictionary, id_col, per_term), id_col, per_term), "first")
    held = texts.join(_sent(materialize(first.select(id_col).distinct(), "held")), id_col, "left_semi").select(*texts.columns)
    matches = materialize(lookup.matches(held, dictionary, id_col), "matches")
    return _covered(terms, first, matches, id_col)


def _sent(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Written hits, broadcast where their counted number is within the bound: rows of the table they meet then stay where they are read."""
    return F.broadcast(hits) if hits.count() <= (MAX_BROADCAST_HITS if most is None else most) else hits


def first_matches(matches: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """Items of each term, with a limit its first in id order: ``term, id``."""
    if limit is None:
        return matches.select("term", id_col)
    order = W.partitionBy("term").orderBy(id_col)
    return (
        matches.select("term", id_col).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit).drop("pos")
    )


def substring_hits(terms: DataFrame, matches: DataFrame, id_col: str, per_term: int | None = None) -> DataFrame:
    """Items found by substring, boosted by how many of the query's terms they cover: ``query_id, id, score``."""
    return _covered(terms, first_matches(matches, id_col, per_term), matches, id_col)


def _covered(terms: DataFrame, first: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    found = terms.select("query_id", "term").join(first, "term").select("query_id", id_col).distinct()
    boost = F.when(F.col("in_head"), HEAD_BOOST).otherwise(BODY_BOOST)
    covered = (
        found.join(terms.select("query_id", "term"), "query_id").join(matches.select("term", id_col, "in_head"), ["term", id_col])
        .groupBy("query_id", id_col).agg(F.sum(boost).alias("boost"))
    )
    return covered.select("query_id", id_col, Q.substring_score(F.col("boost")).alias("score"))


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities once per name: their own and each alias (``id, alias``)."""
    own = entities.select("id", "kind", "name", "canonical_key", "status")
    named = own.drop("name").join(aliases.select("id", F.col("alias").alias("name")), "id")
    return own.unionByName(named)


def entity_hits(terms: DataFrame, entities: DataFrame, per_term: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Active entities whose name or key contains a term, with ``per_term`` each term's first by id: ``query_id, id, kind, title, summary``."""
    active = entities.filter(F.col("status") == "active")
    matches = match_terms(terms.select("term").distinct(), active, "id", ENTITY_TEXT, [], postings)
    named = first_matches(matches, "id", per_term)
    hits = terms.select("query_id", "term").join(named, "term").select("query_id", "id").distinct()
    return _sent(materialize(hits, "entity_hits")).join(active.select("id", "kind", F.col("name").alias("title"), F.col("canonical_key").alias("summary")), "id")


def search(
    queries: DataFrame, chunks: DataFrame, entities: DataFrame | None = None, limit: int = 10, mode: str = "auto",
    postings: DataFrame | None = None, compat: bool = False, max_terms: int | None = None, per_term: int | None = None, store: IndexStore | None = None,
) -> DataFrame:
    """Fused top ``limit`` per query: graph entities, BM25 chunk hits and substring top-up.

    ``max_terms`` keeps the first terms of a query, ``per_term`` the first items by id that a term adds in the substring and
    entity steps; both are off unless given.

    The substring step runs for all terms of a query without BM25 hits and otherwise for its short
    terms only, and adds nothing BM25 already found. Result: ``query_id, pos, kind, id, title, summary,
    page_path, score, rank, body, start_line, end_line``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    terms = query_terms(queries, compat, max_terms)
    head, body = ["title", "summary"], ["body"]
    stored = postings is not None
    if not stored and store is None:
        # counts, ranking, substrings and details each read all chunks: they are cut once
        chunks = materialize(chunks.select("chunk_id", *CHUNK_TEXT, "page_path", "start_line", "end_line"), "chunks")
    # a stored index names the items that may match; they are searched where they are read
    held = chunks if store is None else narrowed(store, terms.select("term").distinct(), chunks)
    # matches from an index and ranked hits are each read several times below: written once, narrow rows only
    matches = materialize(match_terms(terms.select("term").distinct(), chunks, "chunk_id", head, body, postings), "matches") if stored else None
    if mode == "like":
        ranked = None
        like_terms = terms
    else:
        best = bm25_hits(terms, matches, chunks, "chunk_id", CHUNK_TEXT, limit) if stored else bm25_by_scan(terms, chunks, "chunk_id", head, body, limit, held)
        ranked = materialize(best, "ranked")
        answered = ranked.select("query_id").distinct().withColumn("answered", F.lit(True))
        like_terms = terms.join(answered, "query_id", "left").filter(F.col("answered").isNull() | (F.length("term") < GRAM)).drop("answered")
    extra = substring_hits(like_terms, matches, "chunk_id", per_term) if stored else substring_by_scan(like_terms, held, "chunk_id", head, body, per_term)
    if ranked is not None:
        extra = extra.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        chunk_scores = ranked.select("query_id", "chunk_id", "score", F.lit(1).alias("step")).unionByName(
            extra.withColumn("step", F.lit(2))
        )
    else:
        chunk_scores = extra.withColumn("step", F.lit(2))
    scored = chunk_scores.select("query_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "score", "step")
    if entities is not None:
        named = entity_hits(terms, entities, per_term)
        scored = scored.unionByName(
            named.select("query_id", "kind", "id", F.lit(ENTITY_SCORE).alias("score"), F.lit(0).alias("step"))
        )
    top = fuse(scored, terms.select("query_id", "n_terms").distinct(), limit)
    return _with_details(top, chunks, entities)


def fuse(hits: DataFrame, n_terms: DataFrame, limit: int) -> DataFrame:
    """Rank typed hits per query; the first of equal (kind, id) wins, ties break by step and id."""
    single = hits.groupBy("query_id", "kind", "id").agg(F.min(F.struct("step", "score")).alias("s")).select(
        "query_id", "kind", "id", "s.step", "s.score"
    )
    rank = (
        F.col("score") + F.when(F.col("kind") == "chunk", CHUNK_BONUS).otherwise(0.0)
        - F.when((F.col("kind") == "symbol") & (F.col("n_terms") > 1), SYMBOL_MALUS).otherwise(0.0)
    )
    ranked = single.join(n_terms, "query_id").withColumn("rank", F.round(rank, Q.SCORE_DIGITS))
    order = W.partitionBy("query_id").orderBy(F.desc("rank"), "step", "id")
    return (
        ranked.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)
        .select("query_id", F.col("pos").cast("bigint").alias("pos"), "kind", "id", "score", "rank")
    )


def _with_details(top: DataFrame, chunks: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Texts of the final hits only; within the bound no chunk and no entity that is not among them is shuffled."""
    top = materialize(top, "top")
    sent = _sent(top)
    found = (
        sent.filter(F.col("kind") == "chunk")
        .join(chunks.select(F.col("chunk_id").alias("id"), "title", "summary", "page_path", "body", "start_line", "end_line"), "id")
    )
    if entities is None:
        return found
    wanted = _sent(materialize(top.filter(F.col("kind") != "chunk").select("id").distinct(), "entity_ids"))
    known = entities.select("id", "name", "canonical_key").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    named = top.filter(F.col("kind") != "chunk").join(known, "id")
    return found.unionByName(
        named.select(
            "query_id", "pos", "kind", "id", "score", "rank", F.col("name").alias("title"),
            F.col("canonical_key").alias("summary"), F.lit(None).cast("string").alias("page_path"),
            F.lit(None).cast("string").alias("body"), F.lit(None).cast("bigint").alias("start_line"),
            F.lit(None).cast("bigint").alias("end_line"),
        )
    )

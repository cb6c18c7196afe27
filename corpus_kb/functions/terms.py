"""Query tokeniser and score arithmetic as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_kb.functions.text import bind

# fixed values
SEPARATORS = ",.;:!?()[]{}<>/\\|#+=~`@$^&%_\"'*　！，、。：；？（）【】《》—‘’“”"
DELETED = "%\"*'\\"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
WINDOW_QUOTAS = ((4, 4), (3, 4), (2, 10))
FILLER = (
    "怎么 如何 什么 哪些 哪个 是否 可以 这个 那个 我们 以及 还有 为什 么样 的是 是个 在一 们的 是一 在 的呢 是的 "
    "有哪些 是怎么 应该 需要 能够 里面 关于 一下 请问 为什么"
).split()
K1, B = 1.2, 0.75
SCORE_DIGITS = 9

_SEPARATOR_CLASS = r"[\s" + "".join("\\" + c if ord(c) < 128 else c for c in SEPARATORS) + "]+"


def ngrams(text: Column, n: int) -> Column:
    """All ``n``-character windows of a text, in one regex pass.

    The first lookahead keeps a window from starting inside a surrogate pair.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1))


def is_cjk_heavy(token: Column) -> Column:
    count = F.regexp_count(token, F.lit(CJK))
    return (count >= 2) & (count * 2 >= F.length(token))


def _windows(token: Column) -> Column:
    per_size = [
        F.slice(F.filter(ngrams(token, n), lambda w: ~w.isin(*FILLER)), 1, quota) for n, quota in WINDOW_QUOTAS
    ]
    return F.concat(*per_size)


def query_terms(query: Column, compat: bool = False, max_terms: int | None = None) -> Column:
    """Search terms of a question: lower-cased, deduplicated, with ``max_terms`` the first so many.

    Long runs of CJK characters become 4-, 3- and 2-character windows. ``_`` separates words;
    ``compat=True`` deletes it first instead.
    """
    deleted = DELETED + ("_" if compat else "")
    tokens = F.filter(F.split(F.translate(F.lower(query), deleted, ""), _SEPARATOR_CLASS), lambda t: t != "")
    expanded = F.flatten(
        F.transform(
            tokens,
            lambda t: F.when(is_cjk_heavy(t) & (F.length(t) > 4), _windows(t))
            .when(F.length(t) < 2, F.array().cast("array<string>"))
            .otherwise(F.array(t)),
        )
    )
    fallback = F.slice(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), -1, 1)
    last = F.when(F.size(F.filter(F.split(query, r"\s+"), lambda t: t != "")) > 0, fallback)
    return bind(
        F.array_distinct(expanded) if max_terms is None else F.slice(F.array_distinct(expanded), 1, max_terms),
        lambda terms: F.when(F.size(terms) > 0, terms).otherwise(F.coalesce(last, F.array().cast("array<string>"))),
    )


def indexable_terms(terms: Column) -> Column:
    """The terms a trigram index can answer."""
    return F.filter(terms, lambda t: F.length(t) >= 3)


def match_expression(terms: Column) -> Column:
    """Quoted terms joined with OR, as shown to people; retrieval itself uses the term array."""
    return F.array_join(
        F.transform(indexable_terms(terms), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))),
        " OR ",
    )


def occurrences(text: Column, term: Column) -> Column:
    """Number of (non-overlapping) occurrences of a literal term, from byte lengths, which cost nothing to read."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))
    return (removed / F.octet_length(term)).cast("bigint")


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.ln((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def bm25_weight(idf: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """One term's share of a BM25 score (k1 = 1.2, b = 0.75)."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def squash(strength: Column) -> Column:
    return 0.8 + 0.8 * (strength / (strength + 1.0))


def substring_score(boost: Column) -> Column:
    return 0.75 + F.least(boost, F.lit(0.4))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

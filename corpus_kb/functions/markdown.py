"""Markdown structure as Column functions, one row per document and no shuffle.

Running state over the lines of one document (inside a fence? which section?) is obtained by
splitting the text at the lines that change the state: the index of a piece is the state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_kb.functions.text import bind, is_blank, lines, strip, strip_end, strip_start

# fixed values
DEFAULT_TITLE = "Overview"
FENCE = "```"
SUMMARY_CHARS = 180
SUMMARY_MIN = 20
HEADING_CHARS = 120
MIN_CHUNK_CHARS = 400
CLAIM_MIN_BYTES = 8
BACKTICK_FENCE = r"\n(?=[^\S\n]*```)"
ANY_FENCE = r"\n(?=[^\S\n]*(?:```|~~~))"
NUMBERED = "array<struct<line:string,in_fence:boolean>>"


def fence_lines(text: Column, fence: str = BACKTICK_FENCE) -> Column:
    """Lines with fence state: ``array<struct<line, in_fence>>``; an opening line is inside, a closing one outside."""

    def piece_lines(piece: Column, k: Column) -> Column:
        body = F.when(k == 0, F.substring(piece, 2, 2147483647)).otherwise(piece)
        items = F.transform(
            F.split(body, r"\r?\n", -1),
            lambda l: F.struct(l.alias("line"), (k % 2 == 1).alias("in_fence")),
        )
        return F.when((k == 0) & (piece == ""), F.array().cast(NUMBERED)).otherwise(items)

    body = F.regexp_replace(text, r"\r?\n\z", "")
    pieces = F.split(F.concat(F.lit("\n"), body), fence, -1)
    return F.when(text == "", F.array().cast(NUMBERED)).otherwise(F.flatten(F.transform(pieces, piece_lines)))


def heading_title(line: Column) -> Column:
    return strip(F.ltrim(line, F.lit("#")))


def _is_heading(item: Column, heading_regex: str) -> Column:
    return ~item["in_fence"] & item["line"].rlike(heading_regex)


def sections(text: Column, heading_regex: str = "^#") -> Column:
    """Sections by heading outside fences: ``array<struct<title, start_line, end_line, lines>>``."""

    def build(items: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(items) - 1),
            lambda i: (i == 0) | _is_heading(F.get(items, i), heading_regex),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda s, k: bind(
                    F.coalesce(F.get(st, k + 1), F.size(items)),
                    lambda e: F.struct(
                        F.when(_is_heading(F.get(items, s), heading_regex), heading_title(F.get(items, s)["line"]))
                        .otherwise(F.lit(DEFAULT_TITLE)).alias("title"),
                        (s + 1).alias("start_line"),
                        e.alias("end_line"),
                        F.slice(items, s + 1, e - s).alias("lines"),
                    ),
                ),
            ),
        )

    empty = F.array().cast(
        "array<struct<title:string,start_line:int,end_line:int,lines:array<struct<line:string,in_fence:boolean>>>>"
    )
    return bind(fence_lines(text), lambda items: F.when(F.size(items) > 0, build(items)).otherwise(empty))


def summary_of(title: Column, body: Column) -> Column:
    """First prose line of a body as its summary, the title where that line is too short."""
    prose = F.filter(
        F.transform(lines(body), lambda l: strip(l)),
        lambda t: (t != "") & ~t.startswith("#") & ~t.startswith(FENCE) & ~t.startswith("---"),
    )
    return bind(
        F.left(F.get(prose, F.lit(0)), F.lit(SUMMARY_CHARS)),
        lambda s: F.when(F.length(s) >= SUMMARY_MIN, s).otherwise(title),
    )


def _size_cuts(items: Column, target_tokens: int) -> Column:
    """Start offsets of the pieces of one section: a piece closes once it reaches the target outside a fence."""
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, item: Column) -> Column:
        opens = acc["chars"] == 0
        # chars counts one joining newline per line, so a non-empty piece is never zero
        chars = acc["chars"] + F.length(item["line"]) + 1
        full = (F.floor((chars - 1) / 3) + 1 >= target_tokens) & ~item["in_fence"]
        return F.struct(
            F.when(full, F.lit(0)).otherwise(chars).alias("chars"),
            (acc["pos"] + 1).alias("pos"),
            F.when(opens, F.array_append(acc["cuts"], acc["pos"])).otherwise(acc["cuts"]).alias("cuts"),
        )

    return F.aggregate(items, zero, step, lambda acc: acc["cuts"])


def _pieces(text: Column, target_tokens: int, heading_regex: str) -> Column:
    """Non-blank pieces of a page in order: ``array<struct<title, start_line, end_line, body>>``."""

    def cut(section: Column) -> Column:
        return bind(
            _size_cuts(section["lines"], target_tokens),
            lambda cuts: F.transform(
                cuts,
                lambda c, k: bind(
                    F.coalesce(F.get(cuts, k + 1), F.size(section["lines"])),
                    lambda e: F.struct(
                        section["title"].alias("title"),
                        (section["start_line"] + c).alias("start_line"),
                        (section["start_line"] + e - 1).alias("end_line"),
                        F.array_join(
                            F.transform(F.slice(section["lines"], c + 1, e - c), lambda x: x["line"]), "\n"
                        ).alias("body"),
                    ),
                ),
            ),
        )

    pieces = F.flatten(F.transform(sections(text, heading_regex), cut))
    return F.filter(pieces, lambda p: ~is_blank(p["body"]))


def merge_small(pieces: Column, min_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Fold short pieces into the chunk before them unless that one ends with a fence.

    The decision for a piece needs only the piece before it, so groups are found in one pass.
    ``pieces`` holds ``title, start_line, end_line, body`` and optionally ``summary``.
    """

    def build(p: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(0), F.size(p) - 1),
            lambda i: (i == 0)
            | (F.length(strip(F.get(p, i)["body"])) >= min_chars)
            | strip_end(F.get(p, i - 1)["body"]).endswith(FENCE),
        )

        def chunk(first: Column, after: Column) -> Column:
            size = after - first
            parts = F.transform(
                F.slice(p, first + 1, size),
                lambda x, j: bind(
                    F.when(j > 0, strip_start(x["body"])).otherwise(x["body"]),
                    lambda b: F.when(j < size - 1, strip_end(b)).otherwise(b),
                ),
            )
            return F.struct(
                F.get(p, first)["title"].alias("title"),
                F.get(p, first)["start_line"].alias("start_line"),
                F.array_max(F.transform(F.slice(p, first + 1, size), lambda x: x["end_line"])).alias("end_line"),
                F.array_join(parts, "\n\n").alias("body"),
                F.get(p, first)["body"].alias("head_body"),
                F.coalesce(
                    F.get(F.filter(F.transform(F.slice(p, first + 1, size), lambda x: x["summary"]), lambda s: ~is_blank(s)), F.lit(0)),
                    F.lit(""),
                ).alias("summary"),
            )

        return bind(
            opens,
            lambda st: F.transform(st, lambda s, k: bind(F.coalesce(F.get(st, k + 1), F.size(p)), lambda e: chunk(s, e))),
        )

    empty = F.array().cast(
        "array<struct<title:string,start_line:bigint,end_line:bigint,body:string,head_body:string,summary:string>>"
    )
    return bind(pieces, lambda p: F.when(F.size(p) > 0, build(p)).otherwise(empty))


def structural_chunks(
    text: Column, target_tokens: int = 512, heading_regex: str = "^#", min_chars: int = MIN_CHUNK_CHARS
) -> Column:
    """Heading- and fence-aware chunks of a page, short ones merged."""
    with_summary = F.transform(
        _pieces(text, target_tokens, heading_regex),
        lambda p: F.struct(
            p["title"].alias("title"), p["start_line"].cast("bigint").alias("start_line"),
            p["end_line"].cast("bigint").alias("end_line"), p["body"].alias("body"),
            summary_of(p["title"], p["body"]).alias("summary"),
        ),
    )
    return merge_small(with_summary, min_chars)


def first_heading(text: Column) -> Column:
    """First non-empty level-1 heading outside fences, at most 120 characters."""
    found = F.filter(
        fence_lines(text, ANY_FENCE),
        lambda x: ~x["in_fence"] & strip(x["line"]).startswith("# ") & ~is_blank(F.substring(strip(x["line"]), 3, 2147483647)),
    )
    return F.left(strip(F.substring(strip(F.get(found, F.lit(0))["line"]), 3, 2147483647)), F.lit(HEADING_CHARS))


def claims_of(text: Column) -> Column:
    """Bullets under headings that mention claims: ``array<string>`` in order.

    Any line starting with ``#`` opens a part, so the text is split there and each part is in or out.
    """
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=[^\S\n]*#)", -1)
    wanted = F.filter(
        parts, lambda p, k: (k > 0) & F.contains(F.lower(F.split_part(p, F.lit("\n"), F.lit(1))), F.lit("claim"))
    )
    bullets = F.flatten(
        F.transform(
            wanted,
            lambda p: F.filter(F.transform(F.split(p, r"\r?\n", -1), lambda l: strip(l)), lambda t, j: (j > 0) & t.rlike(r"^[-*] ")),
        )
    )
    return F.filter(
        F.transform(bullets, lambda t: F.substring(t, 3, 2147483647)),
        lambda s: F.octet_length(s) >= CLAIM_MIN_BYTES,
    )


def link_targets(text: Column) -> Column:
    """Relative destinations of inline and reference links outside fences and inline code, fragments dropped."""

    def of_line(line: Column) -> Column:
        plain = F.regexp_replace(line, r"`[^`]*(?:`|\z)", "")
        inline = F.regexp_extract_all(plain, F.lit(r"\]\([^\S\n]*<?([^\s)>]*)"), F.lit(1))
        reference = F.regexp_extract_all(plain, F.lit(r"\]:[^\S\n]*(\S+)"), F.lit(1))
        relative = F.filter(
            F.concat(inline, reference),
            lambda d: (d != "") & ~d.startswith("#") & ~d.startswith("/")
            & (d.startswith("./") | d.startswith("../") | ~F.contains(d, F.lit(":"))),
        )
        return F.filter(F.transform(relative, lambda d: F.split_part(d, F.lit("#"), F.lit(1))), lambda d: d != "")

    prose = F.filter(fence_lines(text, ANY_FENCE), lambda x: ~x["in_fence"] & F.contains(x["line"], F.lit("]")))
    return F.flatten(F.transform(prose, lambda x: of_line(x["line"])))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def render_front_matter(fields: Column) -> Column:
    """``MAP<STRING,STRING>`` to a front-matter block with sorted keys."""
    entries = F.transform(
        F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))
    )
    return F.concat(F.lit("---\n"), F.array_join(entries, ""), F.lit("---\n"))


def front_matter(text: Column) -> Column:
    """Front-matter fields as a map, null where there is none."""
    block = F.regexp_extract(text, r"\A\x{FEFF}?---\n((?s:.*?))\n---", 1)
    return F.when(block != "", F.str_to_map(block, F.lit("\n"), F.lit(": ")))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\x{FEFF}?---(?s:.*?)\n---[\r\n]*", "")


def page_content(fields: Column, body: Column) -> Column:
    """Byte-stable page text: writing what was read back changes nothing."""
    return F.concat(render_front_matter(fields), strip_end(F.ltrim(body, F.lit("\n"))), F.lit("\n"))


def code_citations(text: Column) -> Column:
    """Backtick spans that look like a path or an identifier."""
    spans = F.filter(F.split(text, "`", -1), lambda s, i: i % 2 == 1)
    return F.filter(
        F.transform(spans, lambda s: strip(s)),
        lambda s: (F.octet_length(s) >= 4) & ~s.rlike(r"\s")
        & (
            (s.rlike(r"\p{L}") & s.rlike(r"[/.(]|::"))
            | (s.rlike(r"\A[\p{L}\p{N}_]+\z") & s.rlike(r"_|\p{Lu}"))
        ),
    )

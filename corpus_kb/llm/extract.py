"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element. A line weighs as much as it has text outside links; lines of menus, notices,
adverts and the like (by element, role or name) weigh nothing, and so do lines outside ``article`` or ``main`` where a page
has one. A name is a whole class or id, or its last part; ``has-sidebar`` and the like are flags of what holds the text. An ``article`` or ``main``
is never an aside by name, nor is what holds a ``main``; what holds an ``article`` is one only beside marked text. Weights are summed over windows of ``WINDOW`` lines: a surge is a window of at least ``SURGE`` characters (half of the page's
largest window on short pages), a dive is a window without weight. Text between is kept.

The page is parsed tolerantly: tags that are never closed end with their parent, comments and scripts without an end run to the end
of the page. Rows: null and empty html give an empty text; a page without a line of weight gives an empty text; repeated rows and
null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_kb.llm.common import arrow_map

WINDOW, SURGE = 3, 80

_RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "head", "title", "canvas", "select", "audio", "video")
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({"|".join(_RAW)})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|(?=<body\b)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s",
           "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "area", "map", "picture", "source", "input"}
#: Tags that end an open tag of the same row of elements.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "dialog", "menu", "menubar"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation",
          "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "comment", "comments", "respond", "disqus", "replies",
          "footer", "masthead", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login", "search", "widget", "pagination", "pager", "toolbar"}
_MAIN = {"article", "main"}
#: Parts of a class or id that make it a flag, and those that may stand behind a name.
_FLAGS = {"has", "no", "not", "with", "without"}
_BOXES = {"area", "bar", "block", "box", "buttons", "icons", "links", "list", "section", "thread"}


@dataclass
class _Line:
    aside: bool
    main: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names_aside(value: str, names: set[str]) -> bool:
    """Whether a class or id has one of the names: whole, as its last part, or before a word for a box; behind ``--`` stand flags."""
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z]+", token.partition("--")[0]) if p]
        if parts and not _FLAGS & set(parts) and (parts[-1] in names or len(parts) == 2 and parts[0] in names and parts[1] in _BOXES):
            return True
    return False


def _is_aside(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is an aside by what it is, and by its name."""
    if tag in _ASIDE or tag == "header" and not in_main:
        return True, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    named = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name in ("class", "id") and tag != "article":
            named = named or _names_aside(value, _NAMES if in_main else _NAMES | {"header"})
    return False, named


def lines(page: str) -> list[_Line]:
    """Non-empty lines of the page in order."""
    found, holders = _parse(page, frozenset())
    spared = frozenset(holders["main"])
    if spared:
        found, holders = _parse(page, spared)
    if holders["article"] and not any(x.main and not x.aside and x.text for x in found):
        found, _ = _parse(page, spared | holders["article"])
    return found


def _parse(page: str, spared: frozenset[int]) -> tuple[list[_Line], dict[str, set[int]]]:
    """Lines, and the places of elements that are asides by name and hold an ``article`` or a ``main``; those at ``spared`` places are no asides by name."""
    holders: dict[str, set[int]] = {tag: set() for tag in _MAIN}
    open_tags: list[tuple[str, bool, bool]] = []  # tag, aside, main: of it and all around it
    named: list[tuple[int, int]] = []  # depth and place of open elements that are asides by name
    found: list[_Line] = []
    now = _Line(False, False)

    def flush() -> None:
        nonlocal now
        if now.parts and "".join(now.parts).strip():
            found.append(now)
        now = _Line(open_tags[-1][1] if open_tags else False, open_tags[-1][2] if open_tags else False)

    def close(depth: int) -> None:
        del open_tags[depth:]
        while named and named[-1][0] >= depth:
            named.pop()

    def say(text: str) -> None:
        if text:
            text = html.unescape(text)
            now.parts.append(text)
            if any(t[0] == "a" for t in open_tags[-4:]):
                now.linked += len(text.strip())

    last = 0
    for token in _TOKEN.finditer(page):
        say(page[last : token.start()])
        last = token.end()
        closing, tag, attributes = token[2], token[3], token[4]
        if tag is None:
            if token[1]:
                now.parts.append(" ")
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if closing:
            at = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag), None)
            if at is None:
                if block:
                    flush()
                continue
            changed = open_tags[-1][1:] != (open_tags[at - 1][1:] if at else (False, False))
            close(at)
            if block or changed:
                flush()
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if block:
            ends = _ENDS.get(tag, set()) | ({"p"} if tag not in ("option",) else set())
            i = len(open_tags) - 1
            while i >= 0 and open_tags[i][0] in _INLINE:
                i -= 1
            if i >= 0 and open_tags[i][0] in ends:
                close(i)
        aside, main = open_tags[-1][1:] if open_tags else (False, False)
        by_kind, by_name = _is_aside(tag, attributes, main)
        by_name = by_name and token.start() not in spared
        if tag in _MAIN:
            holders[tag].update(place for _, place in named)
        state = (aside or by_kind or by_name, main or tag in _MAIN and not aside)
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            if by_name:
                named.append((len(open_tags), token.start()))
            open_tags.append((tag, *state))
        if block or state != (aside, main):
            flush()
    say(page[last:])
    flush()
    return found, holders


def main_text(page: str | None) -> str:
    """Text between surge and dive points; blocks joined by one space."""
    rows = [(x, x.text) for x in lines(page or "")]
    has_main = any(x.main and not x.aside and t for x, t in rows)
    kept: list[tuple[str, int]] = []  # text (empty in a gap), weight
    for x, text in rows:
        outside = x.aside or has_main and not x.main
        if outside:
            # beside a marked article a gap is one line, however many its menus have
            if not (has_main and kept and not kept[-1][0]):
                kept.append(("", 0))
        elif text:
            linked = x.linked >= 0.9 * len(text)
            kept.append((text, 0 if linked and not has_main else len(text)))
    if not kept:
        return ""
    sums = [sum(w for _, w in kept[i : i + WINDOW]) for i in range(len(kept))]
    surge = min(SURGE, max(sums) / 2)
    out: list[str] = []
    start = 0
    while start < len(kept):
        end = start
        while end < len(kept) and sums[end] > 0:
            end += 1
        if end > start:
            if max(sums[start:end]) >= surge:
                first = next(i for i in range(start, end) if kept[i][1])
                final = next(i for i in range(end - 1, start - 1, -1) if kept[i][1])
                out += [t for t, _ in kept[first : final + 1] if t]
        start = end + 1
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length of every page."""

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x.as_py()) for x in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id long, url string, text string, n_chars long", rows)

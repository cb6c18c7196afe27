import html
import re

import pytest

from corpus_kb.llm import extract
from corpus_kb.llm.common import table

LONG = "This is a paragraph of the article, long enough to make a surge in the sums over windows of lines on its page."


def test_query_against_the_marked_articles(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert len(got) == 250
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", re.sub(r"<(?:/?(?:p|h1)|br)>", " ", inner))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain text only", "plain text only"), ("<p>One &amp; t<b>w</b>o&nbsp;&#x33;<p>three", "One & two 3 three"),
    (f"<nav><a href=/>Home</a></nav><div><h1>T</h1><p>{LONG}<p>End.</div><footer>F</footer>", f"T {LONG} End."),
    (f"<body class='has-sidebar'><div id='menu'>M</div><article><header><h1>T</h1></header><p>{LONG}</p><aside>A</aside><p>Short.</p></article><div>beside</div>", f"T {LONG} Short."),
    (f"<article><p>{LONG}</p><div class='ad'><ul>{'<li>buy' * 9}</ul></div><p>Tail</p></article><section id=comments><article>first!</article></section>", f"{LONG} Tail"),
    (f"<script>if (a < b) x('<p>no</p>')</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG}<!-- never closed <p>no", LONG),
    (f"<form><p>Name</p></form><div class='cookie-notice'><p>We use cookies</p></div><p title='a > b'>{LONG}</p>", LONG),
    (f"<table><tr><td>a<td>b<tr><td>{LONG}</table>", f"a b {LONG}"),
    ("<p>a\n\n  b<br>c</p", "a b c"),
])
def test_pages(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='site has-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<div class='page no-comments with-search layout--sidebar'><p>{LONG}</p></div>", LONG),
    (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG),
    (f"<article class='post sponsored related'><p>{LONG}</p></article><p>beside</p>", LONG),
    (f"<div class='share-enabled widget-ready'><main><p>{LONG}</p></main></div>", LONG),
    (f"<div class='content-sidebar'><div id=search><article><p>{LONG}</p></article></div></div>", LONG),
    (f"<div class='widget'><main><p>{LONG}</p></main></div><article>beside</article>", f"{LONG} beside"),
    (f"<p>{LONG}</p><div class='post-sidebar'><p>{LONG}</p></div><ol class='comment-list'><li>first!</ol>", LONG),
    (f"<article><p>{LONG}</p></article><div class='related'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='has-header'><p>{LONG}</p></div>", LONG),
    (f"<div class='sidebar' hidden><article><p>{LONG}</p></article></div>", ""),
])
def test_names_of_wrappers(page, text):
    assert extract.main_text(page) == text


def test_surge_and_dive_without_a_marked_article():
    links = "".join(f"<div><a href=/{i}>link number {i}</a></div>" for i in range(8))
    assert extract.main_text(f"<div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{links}</div>") == f"{LONG} {LONG}"


def test_edges(spark):
    rows = [(1, "u", None), (None, None, f"<p>{LONG}"), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" + "x y " * 300_000), (4, "u", "<" * 20_000), (5, "u", "<div>" * 20_000 + LONG)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract.extract(df).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 7 and {r.n_chars for r in got} >= {len(LONG), 1_199_999}
    assert extract.extract(df.limit(0)).count() == 0

from __future__ import annotations

import html
import itertools
import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from staffcast.llm import main_text
from staffcast.llm.queries import op13_main_text

FIRST = "The committee met on Tuesday to discuss the plans for the new bridge across the river."
SECOND = "Residents said they were pleased with the outcome, though some had doubts about the cost."


def test_pages_of_the_driver(spark):
    """Their text lies in one article element, without nested elements but of text."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op13_main_text(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S).group(1)
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, expected, len(expected))


WITH = f"<h2>Bridge</h2><p>{FIRST}</p>{{}}<p>{SECOND}</p><p>Yes.</p>"
TEXT = f"Bridge {FIRST} {SECOND} Yes."


@pytest.mark.parametrize("extra", [
    '<div class="ad">Buy the best shoes of the season in our shops now.</div>',
    '<aside>See also the long report about bridges, published last year.</aside>',
    '<div class="cookie-notice"><p>We use cookies to improve this site for you.</p></div>',
    '<div role="alert">The site is closed on Monday for the usual maintenance.</div>',
    '<form action="/in"><label>Write your address here, please.</label><input name="a"><button>Go</button></form>',
    '<section id="comments"><article class="comment"><p>I think that this is a very good idea.</p></article></section>',
    '<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>',
    '<script>var x = "<p>A sentence of the script, as long as others.</p>";</script><style>p{}</style>',
    '<!-- <p>A sentence of the comment, as long as others.</p> -->',
    '<div class="leftSideBar"><p>A sentence of the side bar, as long as others.</p></div>',
    '<select><option>One choice of the many</option></select><textarea>Words to be written</textarea>',
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', "<div>{}</div>"])
def test_what_is_no_main_text(extra, around):
    inside = around.format(WITH.format(extra))
    beside = extra + around.format(WITH.format("")) + extra
    for body in (inside, beside):
        page = f"<html><head><title>No</title></head><body><header><h1>Site</h1></header>{body}<footer>&copy; We</footer></body></html>"
        assert main_text.extract(page) == TEXT


def test_blocks_references_and_broken_markup():
    for page, text in [
        ("<article>a<b>b</b>c<br>d<p> e&nbsp;\n f &lt;x&gt; &#8364;&amp;amp;<p>&unknown; &amp", "abc d e f <x> €&amp; &unknown; &"),
        ("<article><p>one</div></span></p>two</b><p>three</article></article><p>no</p>", "one two three"),
        ("<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>four<td>five<tr><td>six</table></article>",
         "one two three four five six"),
        ('<ARTICLE title="a > b" data-x=\'<p>\'><P>1 < 2 and 3 > 2</P></ARTICLE >', "1 < 2 and 3 > 2"),
        ("<form><article><header><h1>Name</h1></header><p>Text.</p></article></form>", "Name Text."),
        ("<body class=no-sidebar><article><p>Text.</article>", "Text."),
        (f"<table><tr><td><a href=a>Home</a><td><h1>Bridge</h1><p>{FIRST}<p>Yes.<p>{SECOND}<td>Login<tr><td>&copy; 2020 The company.</table>",
         f"Bridge {FIRST} Yes. {SECOND}"),
        (FIRST, FIRST), ("", ""), ("<p></p> \n", ""), ("<article>text<script>no", "text"), ("<article>text<p clas", "text"),
    ]:
        assert main_text.extract(page) == text, page


def cost(labels, content, boilerplate, edges):
    own = sum(content[i] if x else boilerplate[i] for i, x in enumerate(labels))
    return own + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])


@pytest.mark.parametrize("whole", [False, True])
def test_cut_is_the_cheapest_of_all_labellings(whole):
    draw = random.Random(7)
    for _ in range(150):
        n = draw.randint(1, 9)
        some = (lambda top: draw.randint(0, top)) if whole else (lambda top: draw.random() * top)
        content, boilerplate = [some(3) for _ in range(n)], [some(3) for _ in range(n)]
        edges = {p: some(2) for p in itertools.combinations(range(n), 2) if draw.random() < 0.5}
        got = main_text.minimum_cut(content, boilerplate, edges)
        every = {x: cost(x, content, boilerplate, edges) for x in itertools.product((False, True), repeat=n)}
        best = min(every.values())
        assert cost(got, content, boilerplate, edges) == pytest.approx(best)
        assert sum(got) == min(sum(x) for x, c in every.items() if c == pytest.approx(best))


def test_awkward_pages(spark):
    long = "<article>" + f"<p>{FIRST}</p>" * 20_000
    rows = [(1, "u", "<article><p>Same.</article>")] * 3 + [
        (2, None, None), (None, None, ""), (3, "v", long), (4, "w", "</p>" * 1000 + "<div>" * 20_000 + "</section>" * 20_000),
        (5, "x", '<a href="' * 5000), (6, "y", "<!--" * 5000), (7, "z", "<p>\x00� nul"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {c: F.lit(1) for c in ("text", "n_chars", "key")}
    )
    got = [tuple(r) for r in main_text.main_text(pages).collect()]
    assert len(got) == len(rows)
    assert got.count((1, "u", "Same.", 5)) == 3
    assert (2, None, "", 0) in got and (None, None, "", 0) in got
    assert (3, "v", " ".join([FIRST] * 20_000), 20_000 * (len(FIRST) + 1) - 1) in got
    assert main_text.main_text(pages.limit(0)).count() == 0

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from larder.llm import htmlmain

PAGES = "page_id long, url string, html string"


def texts(spark, rows, schema=PAGES):
    return {r["page_id"]: r["text"] for r in htmlmain.extract(spark.createDataFrame(rows, schema)).collect()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="post hentry category-social"><p>Own words</p></article>', "Own words"),
        ('<main class="content no-sidebar"><p>Own words</p></main>', "Own words"),
        ('<body><form id="aspnetForm"><div><p>Own words</p></div><label>Name</label></form></body>', "Own words"),
        ('<form id="aspnetForm"><nav>menu</nav><article>Own words</article></form>', "Own words"),
        ('<div id="page-with-header"><p>Own words</p></div>', "Own words"),
        ('<div class="cookie-banner">Cookies</div><div class=sidebar>a long sidebar with more words than the text</div><article>Own words</article>', "Own words"),
        ('<article><p>Own words</p><div id="comments"><article class="comment">Nice and long comment of a reader</article></div></article>', "Own words"),
        ("<p>Lead outside</p><main><p>Own words</p></main>", "Lead outside\n\nOwn words"),
        ("<table><tr><td>a<td>b<tr><td>c</table>tail", "a\n\nb\n\nc\n\ntail"),
        ("<p title=\"a > b\" class='x'>Own&nbsp;&lt;words&gt;</p><!-- <p>no</p> --><script>'<p>'</script>", "Own <words>"),
        ('<div class="page-header"><h1>Title</h1></div><div class="entry-content"><p>Own words of a page that has many of them</p></div>', "Title\n\nOwn words of a page that has many of them"),
        ('<div><p>Own words that go on for a while</p></div><div class="x1"><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three</a></div>', "Own words that go on for a while"),
        ('<main class="content-sidebar"><p>Own <a href="/a">a</a> <a href="/b">b</a> <a href="/c">c</a></p></main>', "Own a b c"),
        ('<div class="post"><p>Own words of the post, which are many</p></div><div id="comments"><article class="comment"><p>A reader</p></article></div>', "Own words of the post, which are many"),
        ("", ""),
        (None, ""),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_pages_without_statistics(page, text):
    assert htmlmain.main_text(page) == text


def site(n):
    """Neither tags nor names tell the boxes apart; one box holds a line that changes with the page, among constant ones."""
    box = lambda i: f"<div class='b2'><p>About the house and its history since the beginning</p><p>Opening hours and directions to all of our shops</p><p>Page {i}</p></div>"
    return [(i, f"http://s.example/{i}", f"<body><div class='b1'><p>Welcome to our site</p></div>{box(i)}<div class='b3'><h2>Title {i}</h2><p>Text of page {i} in its own words</p></div></body>") for i in range(n)]


def test_only_the_statistics_decide_and_branches_go_whole(spark):
    got = texts(spark, site(40))
    assert got == {i: f"Title {i}\n\nText of page {i} in its own words" for i in range(40)}


PIECES = ('class="related-posts"', 'class="share-buttons"', 'class="adsbygoogle"', 'class="commentlist"', 'class="menu-main-container"', 'class="recent-posts"', 'class="ad-300x250"', 'id="post-comments"', 'class="topnav"', 'class="footer-widgets"', 'class="sponsored-content"', 'class="author-bio"', 'class="skip-link"', 'style="display:none"', 'class="promo" style="color: red"')


@pytest.mark.parametrize("piece", PIECES)
def test_furniture_of_a_host_with_few_pages_goes(piece):
    for outer in ("article", "div class='text'"):
        page = f"<body><{outer}><h1>Title</h1><p>Own words of this page, more than the others have</p><div {piece}><p>other words</p></div></{outer.split()[0]}><div {piece}>more</div></body>"
        assert htmlmain.main_text(page) == "Title\n\nOwn words of this page, more than the others have"


def boxes(n):
    """A box without a telling name, whose words are new on each page, beside the main element; one of links with new words; a copied lead that holds the only title."""
    return [
        (i, f"http://t.example/{i}", f"<body><div class=z1><h1>Title {i}</h1></div><div class=z2>Buy thing {i} of make {i * 7} now</div><main><p>Text {i} of the page, in {i * 3} words, and more of its own that fill it</p></main>"
         f"<div class=z3><div><a href=/x>look {i}</a></div><div><a href=/y>and {i * 5}</a></div></div></body>")
        for i in range(n)
    ]


def test_structure_tells_boxes_with_new_words(spark):
    article = lambda i: f"Text {i} of the page, in {i * 3} words, and more of its own that fill it"
    assert texts(spark, boxes(9)) == {i: f"Title {i}\n\n{article(i)}" for i in range(9)}
    assert all("Buy thing" in t for t in texts(spark, boxes(3)).values())


def test_the_tree_alone_extracts_hosts_with_statistics(spark, monkeypatch):
    """Without any names, and with nav, footer and aside as elements like others, pages of hosts with enough pages come out right; without statistics they don't."""
    monkeypatch.setattr(htmlmain, "named", lambda value: htmlmain.CONTENT)
    monkeypatch.setattr(htmlmain, "_NEVER", htmlmain._NEVER - htmlmain._APART)
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html", htmlmain.host_of().alias("host")).collect()
    pages = Counter(r["host"] for r in rows)
    many = [r for r in rows if r["html"] and pages[r["host"]] >= htmlmain.LEAST_PAGES]
    low = defaultdict(dict)
    for r in htmlmain.low_importance(spark.createDataFrame(many, "page_id long, url string, html string, host string")).collect():
        low[r["host"]][r["key"]] = r["node"] and tuple(r["node"])
    changed = 0
    for r in many:
        found = low[r["host"]]
        want = htmlmain.main_text(re.search(r"(?s)<article>.*</article>", r["html"])[0])
        assert htmlmain.main_text(r["html"], {k for k, v in found.items() if v is None}, {k: v for k, v in found.items() if v}) == want
        changed += htmlmain.main_text(r["html"]) != want
    assert changed == len(many) > 50


def test_both_joins_give_the_same_on_a_whole_table(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    few = {r["page_id"]: r["text"] for r in htmlmain.extract(pages).collect()}
    monkeypatch.setattr(htmlmain, "BROADCAST_ROWS", 0)
    assert {r["page_id"]: r["text"] for r in htmlmain.extract(pages).collect()} == few


def test_few_pages_tell_nothing(spark):
    assert all("Welcome to our site" in t for t in texts(spark, site(3)).values())


def test_importance_against_brute_force(spark):
    rows = [*site(12), (90, "http://s.example/z", "<body><div class='b1'><p>Welcome</p><ul><li>x</ul></div></body>"), (91, "http://s.example/0", site(1)[0][2])]
    nodes, on = defaultdict(set), defaultdict(lambda: defaultdict(set))
    shapes, inside = defaultdict(lambda: defaultdict(set)), set()
    for i, _, page in rows[:-1]:  # the last is a copy of the first
        for n in htmlmain.parse(page):
            if n.length:
                nodes[n.key].add(i)
                shapes[n.key][tuple(n.shape)].add(i)
                for _, t in n.blocks:
                    on[n.key][t].add(i)
    want = {}
    for node, pages in nodes.items():
        m = len(pages)
        if m < htmlmain.LEAST_PAGES:
            continue
        counts = [(len(t) * len(p), len(p)) for t, p in on[node].items()]
        content = sum(w * (1 - math.log(c) / math.log(m)) for w, c in counts) / sum(w for w, _ in counts) if counts else None
        share = Counter({s: len(p) for s, p in shapes[node].items()})
        presentation = -sum(c / sum(share.values()) * math.log(c / sum(share.values()), m) for c in share.values())
        want[node] = (m, content, presentation)
    pages = spark.createDataFrame(rows, PAGES).select("html", htmlmain.host_of().alias("host"))
    got = {r["node"]: (r["m"], r["content"], r["presentation"]) for r in htmlmain.site_trees(pages)[0].collect()}
    assert got.keys() == want.keys()
    for node, (m, content, presentation) in want.items():
        assert got[node][0] == m
        assert (got[node][1] is None) == (content is None)
        assert content is None or got[node][1] == pytest.approx(content, abs=1e-9)
        assert got[node][2] == pytest.approx(presentation, abs=1e-9)


def test_parts_of_a_host_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(htmlmain, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(htmlmain, "COPY_PARTS", 3)
    assert texts(spark, site(8)) == {i: f"Title {i}\n\nText of page {i} in its own words" for i in range(8)}


def test_empty_table_repeats_nulls_and_clashing_columns(spark):
    assert htmlmain.extract(spark.createDataFrame([], PAGES)).count() == 0
    row = (1, "http://a.example/", "<p>x</p>", "h", "l", 5, 7)
    got = htmlmain.extract(spark.createDataFrame([row, row, (None, None, None, None, None, None, None)], PAGES + ", host string, found string, page long, copy long")).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in got) == [(0, "", "", 0), (1, "http://a.example/", "x", 1), (1, "http://a.example/", "x", 1)]


def test_long_and_deep_pages():
    assert htmlmain.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(htmlmain.main_text("<article>" + "<p>a b</p>" * 50_000 + "</article>")) == 5 * 50_000 - 2

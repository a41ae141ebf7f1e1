"""Extraction on pages whose article is known."""

import pytest

from pomelo.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{margin:0}}</style>
<script>var t="</p>";track(1);</script></head><body><header><h1>Site name</h1><a href="/">Home</a></header>
<nav><ul><li><a href="/a">Aa</a></li><li><a href="/b">Bb</a></li></ul></nav><!-- ad <p>1</p> -->
<div class="ad">Buy this, now, really, please, it is cheap, good, and more, of it, than ever.</div>
<div class="cookie-notice"><p>We use cookies, as all do, for this, that, and more of the same thing.</p></div>
<form><label>Mail</label><input><button>Go</button></form>{article}
<aside class="sidebar"><p>Popular, now, here, and there, with many, many, many commas, to score.</p></aside>
<section id="comments"><h2>Comments</h2><p>I think, as a reader, that this, here, is wrong, wrong, wrong.</p></section>
<footer>&copy; site &middot; all rights, reserved, for ever, and ever</footer></body></html>"""


def test_article_with_unclosed_tags():
    article = "<article><h1>Title &amp; more.</h1><p><b>Title &amp; more.<br><p>First,\n para &eacute;.</p><p>Last &#x41;&#66; one.</article>"
    assert main_text(PAGE.format(article=article)) == "Title & more.\n\nTitle & more.\n\nFirst, para é.\n\nLast AB one."


def test_content_without_article_element():
    article = ('<div class="wrap"><div class="x1"><p>A first paragraph, which has some length, and commas.</p>'
               '<p>A second, of the same kind, and nearly as long as that.</p><ul><li>Point one</li><li>Point two</li></ul></div>'
               '<div class="related"><a href="/1">See this</a> <a href="/2">and that</a></div></div>')
    assert main_text(PAGE.format(article=article)) == (
        "A first paragraph, which has some length, and commas.\n\nA second, of the same kind, and nearly as long as that.\n\n"
        "Point one\n\nPoint two")


def test_siblings_are_kept():
    parts = "".join(f"<section><p>Part {i}, with text, and some more text, so that it scores.</p><p>And, again, more.</p></section>" for i in range(3))
    text = main_text(PAGE.format(article=f"<div>{parts}</div>"))
    assert [f"Part {i}" in text for i in range(3)] == [True] * 3 and "Buy" not in text and "reader" not in text


def test_link_lists_within_the_article_go():
    article = '<article><p>Text, that counts.</p><ul><li><a href="/x">More on x</a></li><li><a href="/y">y</a></li></ul><p>End with <a href="z">a link</a>.</p></article>'
    assert main_text(PAGE.format(article=article)) == "Text, that counts.\n\nEnd with a link."


def test_inline_and_space():
    assert main_text("<article><p> a <b>b</b><i>c</i>\t\n d<br>e &nbsp; f </p>tail <pre>x\n  y</pre></article>") == "a bc d e f\n\ntail\n\nx y"


def test_headings_only_and_plain_text():
    assert main_text("<article><h1>Only a title</h1></article>") == "Only a title"
    assert main_text("just text") == "just text"
    assert main_text("<body>bare text, in the body</body>") == "bare text, in the body"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></p>", "<html><body></body></html>", "<![CDATA[x", "&#xFFFFFFFF;&bogus"])
def test_odd_pages_do_not_fail(html):
    assert isinstance(main_text(html), str)


def test_large_and_deep_pages():
    assert main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert main_text("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    assert len(main_text("<article>" + "<p>paragraph, of text.</p>" * 20_000 + "</article>")) == 20_000 * 21 - 2


def test_extract(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("names", ["content-sidebar-wrap", "has-sidebar", "no-sidebar content", "page-with-menu",
                                   "cookies-accepted", "elementor-widget-wrap", "sidebar-wrap", "widget"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_marks_of_wrappers_do_not_prune_the_article(names, tag):
    article = "".join(f"<p>Paragraph {i}, which is long enough, and has some commas, to be the article's.</p>" for i in range(6))
    sidebar = '<div class="sidebar"><p>Popular, now, and here, as ever.</p></div>'
    text = main_text(PAGE.format(article=f'<div class="{names}"><{tag}>{article}</{tag}>{sidebar}</div>'))
    assert [f"Paragraph {i}," in text for i in range(6)] == [True] * 6
    assert not any(x in text for x in ("Buy", "cookies", "Popular", "reader"))


def test_paragraphs_in_marked_elements_of_their_own_and_in_forms():
    parts = "".join(f'<div class="widget"><p>Part {i}, which is long enough, and has some commas, to be text.</p></div>' for i in range(6))
    for page in (f"<div>{parts}</div>", f"<form><div>{parts}</div></form>"):
        text = main_text(PAGE.format(article=page))
        assert [f"Part {i}," in text for i in range(6)] == [True] * 6 and "reader" not in text


def test_long_comments_and_related_articles_still_go():
    comments = "".join(f'<article class="comment-body"><p>I think, {i}, that this, here, is wrong, wrong, and long.</p></article>' for i in range(20))
    cards = '<section class="related"><article><p>Another story, with a teaser, of some length.</p></article></section>'
    page = f'<body><div><p>The story, short, and true.</p><p>It ends, here.</p></div><div class="comments">{comments}</div>{cards}</body>'
    assert main_text(page) == "The story, short, and true.\n\nIt ends, here."
    assert main_text('<p>Text <span class="share">Share</span>goes on.</p>') == "Text goes on."


@pytest.mark.parametrize("wrappers", [8, 12, 70])
def test_paragraphs_in_many_wrappers_of_their_own(wrappers):
    wrapped = lambda i: "<div>" * wrappers + f"<p>Paragraph {i}, which is long enough, and has commas.</p>" + "</div>" * wrappers
    text = main_text("<body><div><span>x</span>" + "".join(map(wrapped, range(400))) + "</div></body>")
    assert [f"Paragraph {i}," in text for i in range(400)] == [True] * 400


LONG = "<p>An opening, long enough, with commas, to be the article.</p>" * 3


@pytest.mark.parametrize("part,seen", [
    ('<section id="related-work"><h2>Related work</h2><p>Others, before us, wrote this.</p></section>', "Others, before us"),
    ('<h2 id="search">Search</h2><h2 id="login">Login</h2><h2 id="alerts">Alerts</h2>', "Search\n\nLogin\n\nAlerts"),
    ('<section id="navigation"><p>Sailors, of old, found their way.</p></section>', "Sailors, of old"),
    ('<p class="search-note">A note, on the search, of sorts.</p>', "A note, on the search"),
    ('<div class="section" id="menus"><h2>Menus</h2><p>Cooks, of old, wrote them.</p></div>', "Cooks, of old")])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_ids_of_headings_mark_nothing_within_the_article(part, seen, tag):
    assert seen in main_text(PAGE.format(article=f"<{tag}>{LONG}{part}</{tag}>"))


@pytest.mark.parametrize("part", ['<section id="comments"><h2>Comments</h2><p>I, for one, disagree.</p></section>', '<div id="sidebar"><p>I, for one, disagree.</p></div>',
                                  '<p class="ad">I, for one, disagree.</p>', '<section id="ads"><p>I, for one, disagree.</p></section>'])
def test_comments_and_adverts_within_the_article_go(part):
    assert "for one" not in main_text(PAGE.format(article=f"<article>{LONG}{part}</article>"))

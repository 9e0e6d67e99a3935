import html
import os
import re
import time

import pyarrow.parquet as pq
import pytest

from grove.llm import html as html_module
from grove.llm.html import extract, extract_pages, parse

ARTICLE = "<article><h1>Head line</h1><p>Some text, with words. And more of it here.</p><p>Second paragraph, which has some words too.</p></article>"
WHOLE = "Head line\nSome text, with words. And more of it here.\nSecond paragraph, which has some words too."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>{body}<footer>&copy; site</footer></body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f'<form id="aspnetForm" method=post><input type=hidden>{ARTICLE}</form>',
        f'<form id="aspnetForm">{ARTICLE}<div class="sidebar"><p>More</p></div></form>',
        ARTICLE.replace("text", "<a href=/it's>text</a>"),
        ARTICLE.replace("text", "<a title=\"a > b\" href='x>y'>text</a>"),
        ARTICLE.replace("</p><p>", "</p><form><p>Get our letter now.</p><input type=email><button>Go</button></form><p>"),
        ARTICLE.replace("</article>", "<form action=/s><label>Your mail</label><input><button>Send it</button></form></article>"),
        ARTICLE.replace("Some text", "<svg><title>icon</title><path d='x'/></svg>Some text</b></i>"),
        f"</div></p>{ARTICLE}",
    ],
)
def test_articles_come_out_whole(trees, body):
    assert extract(page(body), trees) == WHOLE


LONG = "".join(f"<p>Paragraph number {i}, with some words in it. And more.</p>" for i in range(30))


@pytest.mark.parametrize(
    "source",
    [
        *[page(ARTICLE).replace("<body>", f'<body class="{x}">') for x in ("home page has-sidebar", "nav-open", "single-post menu-hidden", "header-sticky", "home page single")],
        page(ARTICLE).replace("<html>", '<html class="comments-open">'),
        page(ARTICLE).replace("<body>", '<body><div class="page header-fixed">').replace("</body>", "</div></body>"),
        *[page(f'<div {x}">{ARTICLE}</div>') for x in ('class="content-with-sidebar', 'id="notice-board', 'class="wrapper nav-open ad-free')],
        page(ARTICLE.replace("<article>", '<div id="comment-policy" class="post">').replace("</article>", "</div>")),
        page(ARTICLE.replace("<article>", "").replace("</article>", "")),
        page('<div class="title"><h1>Head line</h1></div>' + ARTICLE.replace("<h1>Head line</h1>", "")),
        page(f'<div class="wrapper">{ARTICLE}<div class="sidebar"><h3>More</h3><ul><li><a href=/c>C and more</a></ul></div></div>'),
        page(ARTICLE + '<section id="comments"><h3>Comments</h3>' + "".join(f'<div class="comment"><p>I think that this is number {i}, and a good one. Really.</p></div>' for i in range(9)) + "</section>"),
    ],
)
def test_no_name_costs_a_page(trees, source):
    """Names as themes give them to containers of everything, bad words among them."""
    assert extract(source, trees) == WHOLE


@pytest.mark.parametrize("container", ['main class="two-col-sidebar"', 'article class="post tag-x category-social"', 'div class="has-ads related-off"'])
def test_no_name_costs_a_long_article(trees, container):
    assert extract(page(f"<{container}>{LONG}</{container.split()[0]}>"), trees).count("\n") == 29


def test_session_fits_once(spark, trees, monkeypatch):
    made = []
    monkeypatch.setattr(html_module, "train_trees", lambda spark: made.append(1) or trees)
    monkeypatch.setattr(html_module, "_fitted", {})
    df = spark.createDataFrame([(1, "u", page(ARTICLE))], "page_id long, url string, html string")
    assert [r["text"] for _ in range(2) for r in extract_pages(df).collect()] == [WHOLE] * 2 and made == [1]


def test_nothing_is_lost_to_open_controls_and_heads(trees):
    assert "Second paragraph" in extract(page(ARTICLE.replace("<p>Second", "<button>open<p>Second")), trees)
    assert extract(page(ARTICLE.replace("Some", "<math><mi>x</mi></math> Some")), trees) == WHOLE.replace("Some", "x Some")
    assert extract(page(ARTICLE).replace("</head><body>", ""), trees) == WHOLE


def test_trees_are_those_of_browsers():
    def shape(node):
        return node.text if node.tag == "#" else (node.tag, *map(shape, node.children))

    assert shape(parse("<ul><li>a<li>b</ul>c")) == ("#root", ("ul", ("li", "a"), ("li", "b")), "c")
    assert shape(parse("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>")) == ("#root", ("table", ("tr", ("td", "a", ("table", ("tr", ("td", "b"))), "c"), ("td", "d"))))
    assert shape(parse("<div><b>a</div></b>c<p>d<h2>e</span><h3>f")) == ("#root", ("div", ("b", "a")), "c", ("p", "d"), ("h2", "e"), ("h3", "f"))
    assert shape(parse("<div/>a</div><svg/>b<br/>c<i>x<div>y</i>z")) == ("#root", ("div", "a"), ("svg",), "b", ("br",), "c", ("i", "x", ("div", "y", "z")))


def test_hostile_pages_take_time_in_proportion():
    n = 1 << 15
    for source in ("<div>" * n + "</b>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<p>" + "<span>" * n + "<div></div>" * n, "<div><ul>" * n + "<li>" * n, "<a href='" * n, "<a b=" * n, "</" * n, "<!--" * n, "<td>" * n + "</tr>" * n):
        began = time.time()
        parse(source)
        assert time.time() - began < 8


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/pages.parquet"), reason="no sample pages")
def test_sample_pages_equal_their_articles(trees):
    """Our reading of the contract for these pages: the headings and paragraphs of the article element."""
    for source in pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist():
        blocks = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1])
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        assert extract(source, trees) == "\n".join(t for t in texts if t)

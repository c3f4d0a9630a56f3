"""op6 on class names that only look like menus, on embedded content, and on pages without their article tags."""

import re

import pytest

from amperline.llm import htmltext

TREE = htmltext.learned_tree()
P = "A paragraph with enough words to be the text of a page, and then some more words to be sure of it."


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<body class="no-sidebar"><div class="content no-sidebar"><article><h1>T</h1><p>{P}</p></article></div>', f"T\n{P}"),
        (f'<article><div class="article-header"><h1>Title here</h1></div><p>{P}</p></article>', f"Title here\n{P}"),
        (f'<article><header class="entry-header"><h1>Title here</h1></header><p>{P}</p></article>', f"Title here\n{P}"),
        (f'<article><p>{P}</p><section class="related-work"><p>{P}</p></section></article>', f"{P}\n{P}"),
        (f'<article><p>{P}</p><p class="share-price">It rose by two.</p></article>', f"{P}\nIt rose by two."),
        (f"<article><p>{P}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", f"{P}\nso x=2 holds"),
        (f'<article><p>{P}</p><object data="x">Words in place of it</object></article>', f"{P} Words in place of it".replace(f"{P} ", f"{P}\n")),
        (f'<article><p>{P}</p><div class="comment-list"><p>{P}</p></div><div id="comments">{P}</div></article>', P),
        (f'<article><p>{P}</p><div class="post-comments"><p>{P}</p></div><div class="ad-slot">Buy {P}</div></article>', P),
        (f'<div class="site-header"><a href="/">Home</a></div><div class="cookieBar">We use cookies</div><article><p>{P}</p></article><div class="sidebar">{P}</div>', P),
        (f'<article><p title="a hidden gem">{P}</p></article>', P),
        (f'<div style="overflow: hidden !important"><p>{P}</p></div>', P),
        (f'<div style="color:red; display : none"><p>{P}</p></div><div hidden>{P}</div><article><p>{P}</p></article>', P),
        (f'<article><div class="header"><h1>Title</h1></div><p>{P}</p></article>', f"Title\n{P}"),
        ('<article><h2 class="banner">Soups</h2><p class="menu-item-recipe">Boil the beans.</p></article>', "Soups\nBoil the beans."),
        ("<p>Two short</p><p>paragraphs here</p>", "Two short\nparagraphs here"),
        (f'<form action="/x"><div role="main"><h1>Title</h1><p>{P}</p></div></form>', f"Title\n{P}"),
        (f'<main><p>{P}</p></main><section class="comments"><article><p>{P}</p></article></section>', P),
        (f'<div role="navigation">{P}</div><div id="content"><p>{P}</p></div><div role="contentinfo">{P}</div>', P),
        (f'<article data-class="sidebar ad"><p data-x="class=comments">{P}</p><p class=ad>Buy this</p></article>', P),
    ],
)
def test_names(html, text):
    assert htmltext.main_text(html, TREE) == text


def accuracy(change):
    """Share of the blocks of the given pages that are judged as in the page with its article tag."""
    import duckdb

    right = n = 0
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        want = [b.article == 3 for b in htmltext.blocks(html)]
        found = htmltext.blocks(change(html))
        assert len(found) == len(want)
        right += sum(bool(a) == b for a, b in zip(htmltext.classify(TREE, htmltext.block_features(found)), want, strict=True))
        n += len(want)
    return right / n


def test_accuracy_without_article_tags():
    """Three of these pages are in the labelled table, by their lengths only."""
    assert accuracy(lambda s: re.sub("<(/?)article>", r"<\1div>", s)) >= 0.99


def test_accuracy_with_nothing_but_neighbours():
    """No element or class tells of its purpose: lengths, links and neighbours have to."""
    assert accuracy(lambda s: re.sub("<(/?)(?:article|nav|footer)>", r"<\1div>", s).replace(' class="ad"', "")) >= 0.9


def test_neighbours_decide():
    """The same short block is text among paragraphs and none among links."""
    page = "<div>{}</div><div>Six words stand here by themselves</div><div>{}</div>"
    text, link = " ".join(["word"] * 60), "<a>More</a>"
    assert "Six words" in htmltext.main_text(page.format(text, text), TREE)
    assert "Six words" not in htmltext.main_text(page.format(link, link), TREE)


def test_long_page():
    html = "<article>" + f"<p>{P}</p>" * 20_000 + "</article><div " + 'class="x" ' * 10_000
    assert htmltext.main_text(html, TREE).count("\n") == 19_999

"""Pages whose markup misleads: the article is kept and the rest is not."""

import pytest

from geolantern.llm import html

ONE = "The river is the longest of the region and it has been a border for more than a thousand years of its history."
TWO = "It was not until the end of the war that the bridges were built again, and for this the town had to borrow money."
THREE = "By that time most of the people had left, and those who stayed lived on what they could sell in the markets of the coast."
BODY = "".join(f"<p>{x}</p>" for x in (ONE, TWO, THREE))
TEXT = "\n\n".join((ONE, TWO, THREE))


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar"><article>{BODY}</article><div class="sidebar">Other things to read</div></div>',
    f'<div class="content with-sidebar">{BODY}</div>',
    f'<div id="side-effects">{BODY}</div>',
    f'<main><div class="search-algorithms">{BODY}</div></main>',
    f'<div title="a hidden gem">{BODY}</div>',
    f'<article class="card"><p>Also new: a short teaser here</p></article><div>{BODY}</div><article class="card"><p>Another</p></article>',
    f'<section id="social-history">{BODY}</section>',
    f'<p title=don\'t>{ONE}</p><p>{TWO}</p><p class=\'x y\'>{THREE}</p>',
    f'<div data-note="5 > 3" class=main>{BODY}</div>',
    f'<div class="header">{BODY}</div><div class="footer">Imprint</div>',
    f'<nav class="site-nav"><a href="/">Home</a></nav><div class="site-header">Our paper</div>{BODY}<div class="ad-slot-2">Buy the best of it now</div>',
    f'{BODY}<div class="comment-list"><p>{TWO.replace("war", "strike")}</p><p>{ONE.replace("river", "road")}</p><p>{THREE.replace("people", "others")}</p><p>{TWO}x</p></div>',
    f'<div hidden><p>{TWO}</p></div><div hidden="hidden">{BODY}</div>{BODY}',
    f'<div class="cookie-banner"><p>We and our partners use the data of your device for the ads that you see on it.</p></div>{BODY}',
    f'<article>{BODY}</article><div class="related-posts"><p>{ONE} And more.</p></div>',
])
def test_the_article_is_kept_and_nothing_else(page):
    assert html.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>").replace("\n\nAnother", "") in (
        TEXT, "Also new: a short teaser here\n\n" + TEXT)


def test_a_header_inside_the_article_keeps_its_title():
    page = f'<article><header class="entry-header"><h1>The river and its towns</h1></header>{BODY}</article>'
    assert html.main_text(page) == "The river and its towns\n\n" + TEXT


def test_an_advert_in_a_short_page_is_no_article():
    page = '<div><p>The town is small.</p></div><div class="ad"><p>' + ONE + "</p></div>"
    assert ONE not in html.main_text(page)


def test_unclosed_quotes_and_tags():
    for page in ('<p title="never closed>text</p>', "<div class='", "<p", "a < b and c > d", "<p>x<", '<a href="x" y">z</a>'):
        html.main_text(page)
    assert html.main_text('<p alt="5" tall">' + ONE + "</p>") == ONE

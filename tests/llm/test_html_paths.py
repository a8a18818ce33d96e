"""The threshold on tag-path ratios decides: pages whose element names and classes tell nothing."""

import time

import pytest

from spindrift.llm import html_extract
from spindrift.llm.html_extract import main_text

TEXT = [
    "The first paragraph of the story is long enough to count, and it goes on, with commas, for a while longer than a menu does.",
    "A second one follows, with commas, and a full stop; it says what the first one did not, and it names a few more things too.",
    "Short end.",
]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WANT = "\n\n".join(TEXT)

PAGES = [
    # Boilerplate in plain divs inside the article, and without an article.
    (f"<article><div>Share this</div>{BODY}<div>Advertisement</div></article>", WANT),
    (f"<div class=top><ul><li>Home</li><li>News</li><li>About us</li></ul></div><div class=c>{BODY}</div><div>All rights reserved</div>", WANT),
    (f"<div><div>Home</div><div>News</div></div><div>{BODY}</div><div><div>Contact</div></div>", WANT),
    # The same path as a list within the text, but with no text beside it.
    (f"<div><ul><li>Home</li><li>News</li></ul></div><div>{BODY}<ul><li>one</li><li>two</li></ul></div>", WANT + "\n\none\n\ntwo"),
    # Headings, lists, quotes and tables of the text stay.
    (f"<article><h1>Title</h1>{BODY}<h2>Part</h2><p class=lead>Tiny.</p><ul><li>one</li><li>two</li></ul><blockquote><p>Quote.</p></blockquote><table><tr><td>a</td><td>b</td></tr></table></article>", f"Title\n\n{WANT}\n\nPart\n\nTiny.\n\none\n\ntwo\n\nQuote.\n\na\n\nb"),
    # A title in a box of its own.
    (f"<div class=page><div class=title><h1>Title</h1></div><div class=body>{BODY}</div></div>", f"Title\n\n{WANT}"),
    # Text in divs.
    ("<div>" + "".join(f"<div>{t}</div>" for t in TEXT) + "</div>", WANT),
    # Lists of links.
    (f"<div>{BODY}<ul><li><a href=/1>A story with a long title, on another page of ours</a></li><li><a href=/2>Another, with an even longer title than that one</a></li></ul></div>", WANT),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_content_paths(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_without_the_threshold_boilerplate_stays():
    """The threshold, and not element names, keeps it out: at 0 every unlinked block of plain divs is back."""
    for page, want in PAGES[:3]:
        assert main_text(f"<html><body>{page}</body></html>", share=0.0) != want


def test_smoothing_keeps_what_is_short(monkeypatch):
    page, want = PAGES[4]
    assert main_text(page) == want
    monkeypatch.setattr(html_extract, "_TEXTUAL", frozenset())
    assert "Part" not in main_text(page)


@pytest.mark.parametrize("name", ["layout has-sidebar", "page with-ads", "container search-results", "post social", "hero-banner", "content comments-enabled"])
def test_class_words_around_the_article(name):
    assert main_text(f'<html><body><div class="{name}">{BODY}</div></body></html>') == WANT


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<div>" * 60_000 + "x", "<li>" * 30_000, "<p>x</b></i></section>" * 10_000, "<div><li>" * 15_000, "<table><tr><td>" * 10_000 + "x"])
def test_deep_pages_take_time_in_proportion(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3

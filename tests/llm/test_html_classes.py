import pytest

from spindrift.llm.html_extract import main_text

TEXT = ["The first paragraph of the story, long enough to count.", "A second one follows, with commas, and a full stop.", "The third one ends it; nothing more is said here."]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WANT = "\n\n".join(TEXT)
AD = "<div class='ad'>Buy now, all of it, today.</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article class='post category-social'>{BODY}</article>",
        f"<div class='content no-sidebar'>{BODY}</div>",
        f"<div class='has-sidebar'><article>{BODY}</article></div>",
        f"<div id='search-engines-explained'>{BODY}</div>",
        "<main>" + "".join(f"<div class='elementor-widget-text-editor'><p>{t}</p></div>" for t in TEXT) + "</main>",
    ],
)
def test_class_words_do_not_lose_the_article(page):
    assert main_text(f"<html><body>{page}{AD}</body></html>") == WANT


@pytest.mark.parametrize("word", ["sidebar", "related", "comments"])
def test_class_words_still_drop_what_is_beside_it(word):
    assert main_text(f"<html><body><main>{BODY}<div class='{word}'><p>Something else, and short.</p></div></main></body></html>") == WANT


@pytest.mark.parametrize("page", [f"<div class='ad'>{AD * 20}</div><article>{BODY}</article>", f"<div>{BODY}</div><div class='related'><article>A teaser.</article></div>"])
def test_text_beside_the_article_is_not_taken_for_it(page):
    assert main_text(f"<html><body>{page}</body></html>") == WANT


@pytest.mark.parametrize(
    "page",
    [
        "<article><header class='entry-header'><h1>The Title</h1></header>{}</article>",
        "<main><div class='page-header'><h1>The Title</h1></div>{}</main>",
        "<article><div class='hero banner'><div><h1>The Title</h1></div></div>{}</article>",
        "<form id='aspnetForm' method='post'><nav>Home Shop</nav><article><h1>The Title</h1>{}</article><footer>Imprint</footer></form>",
        "<form id='aspnetForm' method='post'><div class='menu'>Home Shop</div><div id='content'><h1>The Title</h1>{}</div></form>",
        "<div class='masthead'><h1>The Site</h1></div><article><h1>The Title</h1>{}</article>",
        "<article><h1>The Title</h1>{}<form><p>Your name, please:</p><input></form></article>",
        "<article><h1>The Title</h1>{}<div role='form'><p>Write to us, and we answer.</p></div></article>",
    ],
)
def test_titles_and_forms_around_the_page(page):
    assert main_text(f"<html><body>{page.format(BODY)}{AD}</body></html>") == "The Title\n\n" + WANT


def test_a_paragraph_of_prose_with_a_weak_word_stays():
    prose = "This paragraph tells at some length why readers share what they read, and what comes of it in the end."
    page = "<article>{}<p class='share'>{}</p></article>"
    assert main_text(page.format(BODY, prose)) == WANT + "\n\n" + prose
    assert main_text(page.format(BODY, "<a href=x>Share this</a> on a site.")) == WANT
    assert main_text(page.format(BODY, prose).replace("'share'", "'cookie-notice'")) == WANT


def test_a_form_page_of_its_own_has_no_article():
    assert main_text(f"<html><body><div>{BODY}</div><form class='login'><p>Name, and password, please.</p><button>Go</button></form></body></html>") == WANT

"""Pages whose text lies in containers with names, and forms, that look like layout."""

from __future__ import annotations

import pytest

from graphloom.llm.html_text import extract

PROSE = "The patient was seen again after six weeks, and the dose was lowered, which helped a great deal with the sleep."


@pytest.mark.parametrize(
    "inner, lost",
    [
        (f'<div class="side-effects"><h2>Side effects</h2><p>{PROSE}</p></div>', ""),
        (f'<section id="social-history"><h3>Social history</h3><p>Smokes.</p></section>', ""),
        (f'<div class="editor-comment"><p>{PROSE}</p></div>', ""),
        ('<div class="share-buttons"><p>Share this story with friends and family on every network that you use today, it helps us.</p></div>', "Share this"),
        ('<div class="related-links"><h3>Related</h3><ul><li><a href="#">One more story</a></li></ul></div>', "Related"),
        ('<div class="social-history-links"><a href="#">One story about this and that, for all of those who have read so far down</a></div>', "One story"),
        ('<div class="reader-comments"><p>First! I liked this article a great deal, and so did all of my friends, I think.</p></div>', "First!"),
        ('<form action="/subscribe"><label>Mail</label><p>Sign up for letters that come every week, with all the best that we have written.</p><input name="m"></form>', "Sign up"),
    ],
)
def test_names_inside_an_article(inner, lost):
    page = f"<html><body><article><h1>A title</h1><p>{PROSE} One.</p><p>{PROSE} Two.</p>{inner}<p>{PROSE} Three.</p></article></body></html>"
    text = extract(page)
    assert text.startswith("A title\n") and text.count("The patient") >= 3
    if lost:
        assert lost not in text
    else:
        assert text.count("\n") >= 4 and ("Smokes." in text or "Side effects" in text or text.count("The patient") == 4)


def test_a_form_around_the_page():
    page = f'<html><body><form id="aspnetForm" method="post"><div class="nav"><a href="/">Home</a></div><div><h1>A title</h1><p>{PROSE}</p><p>{PROSE}</p></div><input type="hidden" name="x"></form></body></html>'
    assert extract(page) == f"A title\n{PROSE}\n{PROSE}"


def test_a_page_that_is_a_form():
    page = "<html><body><form><label>Name</label><input><p>All fields are needed.</p><button>Send</button></form></body></html>"
    assert extract(page) == ""

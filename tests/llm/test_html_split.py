"""Main text that is split over siblings, and elements that only look marked as something else."""

import pytest

from revlens.llm.htmltext import extract


def paragraphs(name, n=10, size=500):
    texts = [f"{name} {k} " + "word " * ((size - 10) // 5) for k in range(n)]
    return "".join(f"<p>{t}</p>" for t in texts), [t.strip() for t in texts]


def test_text_split_over_siblings():
    parts = [paragraphs(x) for x in ("one", "two", "three")]
    links = "<div>" + "".join(f"<a href=/{k}>some page {k}</a> " for k in range(30)) + "</div>"
    page = "<body>" + links + "".join(f"<div>{h}</div>" for h, _ in parts) + "<div>short line</div>" + links + "</body>"
    assert extract(page).split("\n") == [t for _, ts in parts for t in ts]
    deep = "<body><div>" + "".join(f"<section><div>{h}</div></section>" for h, _ in parts) + "</div><div>(c)</div></body>"
    assert extract(deep).split("\n") == [t for _, ts in parts for t in ts]


def test_articles_beside_each_other():
    parts = [paragraphs(x) for x in ("one", "two")]
    page = "<body>" + "".join(f"<article><h1>Head</h1>{h}</article>" for h, _ in parts) + f"<div>{paragraphs('no')[0]}</div></body>"
    assert extract(page).split("\n") == [x for _, ts in parts for x in ["Head", *ts]]


@pytest.mark.parametrize(
    "name", ["page has-sidebar", "content no-header", "layout with-footer", "sidebar", "main-nav page", "site-footer"]
)
@pytest.mark.parametrize("tag", ["div", "article"])
def test_marked_wrappers(name, tag):
    h, texts = paragraphs("text")
    inner = f"<{tag}>{h}</{tag}>"
    assert extract(f"<body><p>Small</p><div class='{name}'>{inner}<div class=comments>{h * 3}</div></div></body>").split("\n") == texts
    assert extract(f"<body><form><div id=x><div class='{name}'>{inner}</div></div></form></body>").split("\n") == texts


def test_marks_in_other_attributes():
    h, texts = paragraphs("text", 3)
    words = "<p title='hidden gems'>With <a href='/x?id=search'>a link</a> and <a data-class=nav href='?class=ad' alt=\"role=menu\">one more</a> in it.</p>"
    assert extract(f"<body><div>{h}{words}</div></body>").split("\n") == [*texts, "With a link and one more in it."]


@pytest.mark.parametrize("mark", ["class='post comments'", "id=cookie-notice", "class=site-footer", "role=navigation", "hidden", "class=ad-1"])
def test_marked_elements_still_go(mark):
    h, texts = paragraphs("text", 3)
    other = paragraphs("no", 8)[0]
    assert extract(f"<body><div>{h}</div><div {mark}>{other}</div></body>").split("\n") == texts
    assert extract(f"<body><div>{h}<div {mark}>{other}</div></div></body>").split("\n") == texts


def test_many_nested_wrappers_take_linear_time():
    assert extract("<div class=sidebar>" * 20_000 + "deep text") == "deep text"


WRAPPERS = (
    "related-posts related-articles recommended-reading comment-body comment-thread reader-comments user-comments post-comments commentlist share-buttons ad-slot adsbygoogle sponsored-content "
    "newsletter-form breadcrumb-trail widget_recent rightbar comments-section sidebar-left social-links article-share promo-box cookie-bar in-article-ad related_stories subscribe-cta "
    "advertisement-label pagination-links disqus_thread replies-list"
).split()


@pytest.mark.parametrize("inside", [False, True])
def test_marked_wrappers_go_beside_and_inside_the_article(inside):
    story = "".join(f"<p>Paragraph {k} of the story tells at some length what has happened in the town this week, and why.</p>" for k in range(6))
    wanted = "\n".join(f"Paragraph {k} of the story tells at some length what has happened in the town this week, and why." for k in range(6))
    for name in WRAPPERS:
        junk = f'<div class="{name}">' + "".join(f"<p>Junk {k} that stands in a box of its own and says nothing of the matter at all.</p>" for k in range(3)) + "</div>"
        page = f"<html><body><article>{story}{junk if inside else ''}</article>{'' if inside else junk}</body></html>"
        assert extract(page) == wanted, name
        plain = f"<html><body><div class='entry'>{story}{junk if inside else ''}</div>{'' if inside else junk}</body></html>"
        assert extract(plain) == wanted, name


def test_wrappers_that_only_speak_of_such_things_stay():
    story = "".join(f"<p>Paragraph {k} of the story tells at some length what has happened in the town this week, and why.</p>" for k in range(6))
    for name in ("has-sidebar", "no-comments", "with-ads", "content has-related", "post-share-wrap", "ad-free"):
        assert extract(f"<html><body><div class='{name}'>{story}</div></body></html>").count("\n") == 5, name


def test_open_inline_elements_are_climbed_once():
    import time

    began = time.perf_counter()
    n = 80_000
    assert extract("<html><body>" + "<b>" * n + "<li>x</li>" * n + "</body></html>").count("x") == n
    assert time.perf_counter() - began < 20

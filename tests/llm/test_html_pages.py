"""Pages with a known article under odd wrappers: all of it comes back, and nothing else."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from millrace.llm import html_text

PARTS = ["The first paragraph of the text goes on for quite some words, as articles do.", "A second one follows & says more, with a <b>bold</b> word.", "Short end."]
TEXT = "\n\n".join(["Heading", PARTS[0], "A second one follows & says more, with a bold word.", PARTS[2]])
INNER = f"<h1>Heading</h1><p>{PARTS[0]}</p><p>{PARTS[1].replace('&', '&amp;')}</p><p>{PARTS[2]}</p>"
AROUND = ["<header>Site</header><nav><ul><li>One</li></ul></nav>{}<footer>foot</footer>", "<div class='sidebar'><p>Side text</p></div>{}<div id='comments'><article class='comment'><h3>Jo</h3><p>Nice text!</p></article></div>", "{}"]
WRAPPERS = [
    "<article>{}</article>",
    "<main>{}</main>",
    "<article><div class='post-social-share-enabled'>{}</div></article>",
    "<main><section class='product-notice'>{}</section></main>",
    "<main><div id='ad-free-reading'>{}</div></main>",
    "<div class='entry'>{}</div>",
    "<div class='content no-comments'><div>{}</div></div>",
]
PAGES = ["<body>{}</body>", "<body><div class='layout has-sidebar'>{}</div></body>", "<body><form id='aspnetForm' action='/'>{}</form></body>", "<body class='page with-banner'><div class='menu-open'>{}</div></body>"]
LEFT_OUT = ["<form class='newsletter'><p>Sign up</p><input name=m></form>", "<div class='ad'>Buy</div>", "<div class='cookie-notice'><p>We use cookies</p></div>", "<aside><p>Aside</p></aside>", "<div class='share-buttons'><a href=x>Tweet</a></div>", "<section class='related-posts'><p>See also</p></section>", "<script>var a='<p>x</p>'</script>", "<div role='navigation'>Up</div>"]


@pytest.mark.parametrize("page, around, wrapper", list(itertools.product(range(len(PAGES)), range(len(AROUND)), range(len(WRAPPERS)))))
def test_known_article(page, around, wrapper):
    rng = random.Random(page * 100 + around * 10 + wrapper)
    inner = INNER
    for part in rng.sample(LEFT_OUT, 3):
        inner = inner.replace("</p><p>", f"</p>{part}<p>", 1) if rng.random() < 0.5 else inner + part
    html = PAGES[page].format(AROUND[around].format(WRAPPERS[wrapper].format(inner)))
    assert html_text.main_text(f"<html><head><title>t</title></head>{html}</html>", None) == TEXT


def test_comments_longer_than_the_article():
    comments = "".join(f"<article class='comment-body'><p>{'An opinion that goes on and on. ' * 20}</p></article>" for _ in range(5))
    html = f"<body><div class='post'>{INNER}</div><section class='comments-area'><div class='comment-list'>{comments}</div></section></body>"
    assert html_text.main_text(html, None) == TEXT


def test_forms_of_fields_are_left_out():
    form = "<form><label>Name</label><input name=a><p>Your mail stays with us.</p><button>Send</button></form>"
    assert html_text.main_text(f"<body><article>{INNER}{form}</article></body>", None) == TEXT


def test_query_over_extra_columns(spark):
    rows = [(1, "http://h/1", PAGES[1].format(WRAPPERS[5].format(INNER)), 7), (2, "http://h/2", None, 8), (1, "http://h/1", PAGES[1].format(WRAPPERS[5].format(INNER)), 7)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + INNER + "</div>" * 20_000
    began = time.monotonic()
    assert html_text.main_text(f"<body>{deep}</body>", None) == TEXT
    long = "<article><h1>Heading</h1>" + "<p>one more paragraph</p>" * 50_000 + "</article>"
    assert html_text.main_text(long, None).count("\n\n") == 50_000
    assert time.monotonic() - began < 20


def test_teasers_beside_the_article_are_left_out():
    teasers = "".join(f"<article><h3>Other {k}</h3><p>{'teaser ' * 9}</p></article>" for k in range(3))
    html = f"<body><div class='related-posts'>{teasers}</div><div class='post'>{INNER}<p>{'More of the text itself. ' * 30}</p></div></body>"
    assert html_text.main_text(html, None).startswith(TEXT[:60]) and "Other" not in html_text.main_text(html, None)

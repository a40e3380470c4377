"""Page shapes around one article: its text comes out whole, and nothing else."""

import time

import pytest

from gridloom.llm.html_text import main_text

LONG = "A sentence with words, and commas, that runs on for a while so that it scores. " * 3
BODY = f"<h1>Title &amp; more</h1><p>{LONG}</p>\n<p>Two  words,\n and a <b>third</b>.</p><p>{LONG}</p><ul><li>one<li>two</ul><p>Short.</p>"
TEXT = "\n\n".join(["Title & more", LONG.strip(), "Two words, and a third.", LONG.strip(), "one", "two", "Short."])
READER = "<p>I, for one, think that this, as it stands, is wrong, and, well, dull.</p>" * 2

WRAPPERS = {
    "div": "<div>%s</div>",
    "article": "<article>%s</article>",
    "main": "<main><div>%s</div></main>",
    "body only": "%s",
    "server form": '<form id="aspnetForm" method=post><div>%s</div></form>',
    "form around all": '<form><div id=page><div class=menu><a href=/>x</a></div>%s<div class=footer>f, f, f</div></div></form>',
    "no-sidebar": '<div class="no-sidebar">%s</div>',
    "has-comments": '<div class="has-comments">%s</div>',
    "has-sidebar article": '<div class="layout has-sidebar"><article>%s</article></div>',
    "with-sidebar": '<div class="page with-sidebar-left"><div>%s</div></div>',
    "page-header": '<div class="page-header">%s</div>',
    "site-notice": '<section id="site-notice">%s</section>',
    "widget": '<div class="main-widget"><div><div>%s</div></div></div>',
    "content-sidebar": '<div class="content-sidebar">%s</div>',
    "comments around the article": '<div class="comments-wrapper"><article>%s</article></div>',
    "role banner": '<div role="banner"><div>%s</div></div>',
    "nested wrappers": '<form><div class="widget"><div class="alert"><div>%s</div></div></div></form>',
    "table": "<table><tr><td>%s</td></tr></table>",
    "unclosed": "<div><section>%s",
    "center, font": "<center><font color=red><div>%s</div></font></center>",
    "upper case": "<DIV CLASS='Story'>%s</DIV>",
    "comment": "<!-- <div class=x> --><div>%s<!-- </div> --></div>",
    "wrong end tags": "</p></span></div><div>%s</b></td></div>",
    "search in the name of the wrapper": '<div class="is-search-page">%s</div>',
}
AROUND = {
    "nothing": "%s",
    "menus": "<nav><ul><li><a href=/a>A, a</a><li><a href=/b>B, b</a></ul></nav>%s<footer>&copy; all, of, it</footer>",
    "class menus": "<div class=navbar><ul><li><a href=/a>A, a</a></ul></div>%s<div id=footer><p>By, the, owners, of, this, page.</p></div>",
    "sidebar": f"<div class=sidebar><h3>More</h3><p>{LONG}</p></div>%s",
    "aside": f"%s<aside><p>{LONG}</p></aside>",
    "advert": f"<div class=ad>{LONG}</div>%s<div class='ad-slot'><p>Buy, buy, buy.</p></div>",
    "cookie notice": "<div class='cookie-consent'><p>We use cookies, lots, of, them.</p></div>%s",
    "notice": "<div class=notice><p>Closed, on Monday, for all.</p></div>%s",
    "form": "%s<form><p>Write, to, us.</p><input name=q><textarea>x, y</textarea><select><option>a, b<option>c</select></form>",
    "comments": f"%s<section id=comments><h2>Comments</h2><article class=comment>{READER}</article><article class=comment>{READER}</article></section>",
    "scripts": "<script>var a='<p>x, y, z</p>';</script><style>p{x:y,z}</style>%s<noscript><p>Turn, it, on.</p></noscript>",
    "hidden": f"<div hidden><p>{LONG}</p></div>%s<div style='display: none'><p>{LONG}</p></div>",
}


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_shape(wrapper, around):
    if wrapper == "unclosed" and around not in ("nothing", "sidebar", "notice", "cookie notice"):
        return  # what follows is inside, for the lack of an end tag
    page = f"<!DOCTYPE html><html><head><title>T, t</title></head><body>{AROUND[around] % (WRAPPERS[wrapper] % BODY)}</body></html>"
    assert main_text(page) == TEXT


def test_noise_inside_the_article_goes():
    body = BODY.replace("<ul>", f"<div class=ad>Buy, buy.</div><div class='share-buttons'><a href=x>Tell, all</a></div><aside>{LONG}</aside><form><p>Mail, us.</p></form><ul>")
    for tag in ("article", "div"):
        assert main_text(f"<{tag}>{body}</{tag}>") == TEXT


def test_text_in_formulas_and_drawings_stays():
    assert main_text("<div><p>Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math>, and <svg><title>t</title><text>label</text></svg> too.</p></div>") == "Let x = 1, and label too."


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</span></p></b></section>" * 20_000, "<x>a" * 10_000 + "</y>" * 10_000 + "<p>b<table>" + "<x>" * 10_000 + "<h1>a</h1>" * 10_000, "<div class=header>a, b" * 20_000, "<li>a" * 40_000, "<" * 100_000, '<a "' * 30_000])
def test_time_is_linear(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 8

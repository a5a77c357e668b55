"""Main text of pages: the parser on odd markup, the field against plain sums over all state sequences, held-out accuracy."""

import html
import itertools
import re

import numpy as np
import pytest

from seasonflow.llm import page_kit, pages, registry


@pytest.fixture(scope="module")
def model():
    return pages.train(page_kit.labelled_pages(600))


def texts(page):
    return [b.text for b in pages.blocks(page)[0]]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]), ("<p><b>a<br>b<br><p>c", ["a b", "c"]),
    ("<p>x &amp; y&nbsp;&#233;&eacute; &lt;b&gt;</p>", ["x & y éé <b>"]), ("<p>1<script>var t='</p>';</script>2</p>", ["1", "2"]),
    ("<style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- cut", ["yes"]), ("<p>a < b and 3 <4</p>", ["a < b and 3 <4"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p title='a>b' data-x=\"</p>\">t</p>", ["t"]), ("<p title=it's>a</p><p>b's</p>", ["a", "b's"]), ("<p>a</p></div></p></li>b", ["a", "b"]),
    ("<svg><text>no</text><p>yes</p>", ["yes"]), ("<noscript><p>no</p></noscript>yes<template>no</template>", ["yes"]),
    ("<p>cut <a href='x", ["cut"]), ("<P CLASS=x>A</P><DIV>b<SPAN>c</SPAN></DIV>", ["A", "bc"]), ("<?php x ?><!DOCTYPE html>a<![CDATA[x]]>b", ["ab"]),
    ("<textarea>no</textarea><select><option>a<option>b</select>", ["a", "b"]), ("<!-->a<p>b", ["a", "b"]),
])
def test_leaf_blocks(page, want):
    assert texts(page) == want


def test_elements_around_a_block():
    found, title = pages.blocks("<title>T &amp; t</title><body class=x><main id=main-copy><p>a<div class='adBox'><p>b <a href=/>link</a></div>c</main>")
    assert title == "T & t" and [b.text for b in found] == ["a", "b link", "c"]
    assert {"main", ".main", ".copy", "p"} <= found[0].element.around and ".x" not in found[0].element.around
    assert {".ad", ".box", "main"} <= found[1].element.around and found[1].element.near == {"div", ".ad", ".box", "^ad", "^box"}
    assert found[1].linked == 4 and found[2].element.near == found[0].element.near and ".ad" not in found[2].element.around


@pytest.mark.parametrize("page", [
    "<div>" * 30_000 + "deep", "<li>" * 30_000 + "x", "<p><b>" * 30_000 + "x", "<a href=\"" * 20_000, "<!--" * 30_000, "<p>x" * 50_000, "<" * 100_000,
    "<table><tr><td>" * 5_000 + "x", "<script>" * 20_000, "<div class='c" + " c" * 100_000 + "'>x", "&" * 100_000, "<svg>" * 20_000 + "x",
])
def test_hostile_pages_take_linear_time(page, model):
    pages.main_text(page, model, {}, {})


def toy(seed, n=3):
    g = np.random.default_rng(seed)
    size = 4
    theta = g.normal(size=size + 10)
    y, changed = g.integers(0, 2, (n, 5)), g.integers(0, 2, (n, 5))
    there = np.arange(5) < np.array([5, 3, 1])[:n, None]
    at = np.repeat(np.flatnonzero(there.ravel()), 2)
    return theta, size, at, g.integers(0, size, len(at)), np.where(there, y, 0), there, changed


def log_likelihood(theta, n, at, of, y, there, changed):
    """By the sum over all sequences of states."""
    move = theta[n : n + 8].reshape(2, 2, 2)
    main = np.bincount(at, theta[of], y.size).reshape(y.shape)
    total = 0.0
    for k in range(len(y)):
        m = there[k].sum()

        def value(states, k=k, m=m):
            s = sum(main[k, i] for i in range(m) if states[i]) + theta[n + 8] * states[0] + theta[n + 9] * states[-1]
            return s + sum(move[changed[k, i], states[i - 1], states[i]] for i in range(1, m))

        every = [value(s) for s in itertools.product((0, 1), repeat=m)]
        total += value(tuple(y[k, :m])) - np.logaddexp.reduce(every)
    return total


@pytest.mark.parametrize("seed", range(5))
def test_gradient_against_differences_of_the_likelihood(seed):
    theta, *rest = toy(seed)
    got = pages.gradient(theta, *rest)
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((log_likelihood(up, *rest) - log_likelihood(down, *rest)) / 2e-5 - got[k]) < 1e-5


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_finds_the_best_of_all_sequences(seed):
    g = np.random.default_rng(seed)
    scores, changed = g.normal(size=7).tolist(), g.integers(0, 2, 6).tolist()
    m = pages.Model({}, tuple(map(tuple, g.normal(size=(2, 2, 2)).tolist())), tuple(g.normal(size=2).tolist()))

    def value(s):
        return sum(x for x, a in zip(scores, s) if a) + m.ends[0] * s[0] + m.ends[1] * s[-1] + sum(m.steps[c][a][b] for c, a, b in zip(changed, s, s[1:]))

    assert pages.viterbi(scores, changed, m) == list(map(bool, max(itertools.product((0, 1), repeat=7), key=value)))


def test_held_out_pages(model):
    held = page_kit.labelled_pages(500, first=10**6)
    known, kept = {}, {}
    got = [pages.main_text(h, model, known, kept)[0] for h, _ in held]
    assert sum(a == t for a, (_, t) in zip(got, held)) > 0.95 * len(held)
    both = sum(len(set(a.split("\n")) & set(t.split("\n"))) for a, (_, t) in zip(got, held))
    assert both > 0.98 * sum(len(set(a.split("\n"))) for a in got) and both > 0.98 * sum(len(set(t.split("\n"))) for _, t in held)

S = "Ofshhable for esti ateded inednt erreing shnd whblewh of haon oneaing. Tionen with thsher ththbleti heeashen from."
ARTICLE = f"<article><h1>The title here</h1><p>{S}</p><p>{S}</p><h2>Sub head</h2><p>Short.</p><ul><li>one item</li><li>two items</li></ul></article>"
WHOLE = f"The title here\n{S}\n{S}\nSub head\nShort.\none item\ntwo items"
NAV = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "En la et des".split()) + "</ul></nav>"
FOOT = f"<footer>&copy; blog.example.com &middot; {S}</footer>"
VARIANTS = {
    'comments section': NAV + ARTICLE + f'<section class="comments"><h2>Comments</h2><div class="comment"><p>{S}</p></div><div class="comment"><p>{S}</p></div></section>' + FOOT,
    'comments id div': NAV + ARTICLE + f'<div id="comments"><p>{S}</p><p>{S}</p></div>' + FOOT,
    'comments ol': NAV + ARTICLE + f'<ol class="comment-list"><li>{S}</li><li>{S}</li></ol>' + FOOT,
    'aside': NAV + ARTICLE + f'<aside><h3>Rel</h3><p>{S}</p></aside>' + FOOT,
    'sidebar div': NAV + f'<div class="sidebar"><p>{S}</p><p>{S}</p></div>' + ARTICLE + FOOT,
    'cookie': f'<div class="cookie-notice"><p>{S}</p></div>'+NAV + ARTICLE + FOOT,
    'notice': f'<div class="notice">{S}</div>'+NAV + ARTICLE + FOOT,
    'header': f'<header><h1>Site name</h1><p>{S}</p></header>'+NAV + ARTICLE + FOOT,
    'form': NAV + ARTICLE + f'<form action="/s"><label>{S}</label><input><button>Go</button></form>' + FOOT,
    'ad inside': NAV + ARTICLE.replace('<h2>',f'<div class="ad">{S}</div><h2>') + FOOT,
    'aside inside': NAV + ARTICLE.replace('<h2>',f'<aside><p>{S}</p></aside><h2>') + FOOT,
    'comments inside article': NAV + ARTICLE.replace('</article>',f'<section class="comments"><p>{S}</p></section></article>') + FOOT,
    'nested article comments': NAV + ARTICLE + f'<section id="comments"><article><h3>Bob</h3><p>{S}</p></article></section>' + FOOT,
    'main div': NAV + '<div id="main" class="content">' + ARTICLE.replace('article','div')+'</div>' + FOOT,
    'no wrapper names': NAV + '<main>' + ARTICLE.replace('article','div')+'</main>'+f'<div class="footer">{S}</div>',
    'post class': '<div class="menu"><a href=/>Home</a> <a href=/>About</a></div><div class="post">' + ARTICLE.replace('<article>','').replace('</article>','')+f'</div><div class="related"><p>{S}</p></div><div class="footer"><p>{S}</p></div>',
    'header in article': NAV + ARTICLE.replace('<h1>The title here</h1>','<header><h1>The title here</h1></header>') + FOOT,
    'banner promo': f'<div class="promo-banner"><p>{S}</p></div>'+NAV + ARTICLE + f'<div class="newsletter"><p>{S}</p><form><input></form></div>' + FOOT,
    'dialog': f'<div role="dialog"><p>{S}</p></div>'+NAV + ARTICLE + FOOT,
    'noscript/template': NAV + f'<noscript><p>{S}</p></noscript>' + ARTICLE + FOOT,
    'table': NAV + ARTICLE.replace('<ul><li>one item</li><li>two items</li></ul>','<table><tr><td>one item</td><td>two items</td></tr></table>') + FOOT,
    'blockquote': NAV + ARTICLE.replace('<p>Short.</p>','<blockquote>Short.</blockquote>') + FOOT,
    'figure': NAV + ARTICLE.replace('<p>Short.</p>','<figure><img src=x><figcaption>Short.</figcaption></figure>') + FOOT,
    'empty article': NAV + '<article></article>' + FOOT,
    'only nav': NAV + FOOT,
    'one para': NAV + f'<article><p>{S}</p></article>' + FOOT,
    'one word': NAV + '<article><h1>Auxpa.</h1><p>Auxpa.</p></article>' + FOOT,
    'reader-comments': NAV + ARTICLE + f'<div class="reader-comments"><div class="c"><b>Ann</b> {S}</div></div>' + FOOT,
    'alert': f'<div class="alert alert-info">{S}</div>'+NAV + ARTICLE + FOOT,
    'breadcrumb': NAV + f'<div class="breadcrumb"><a href=/>Home</a> / <a href=/>B</a></div>' + ARTICLE + FOOT,
}
SHORT = {"empty article": "", "only nav": "", "one para": S, "one word": "Auxpa.\nAuxpa."}


@pytest.mark.parametrize("name", sorted(VARIANTS))
def test_parts_around_and_inside_an_article(model, name):
    page = f"<!DOCTYPE html><html><head><title>The title here</title><script>var t='</p>';</script></head><body>{VARIANTS[name]}</body></html>"
    assert pages.main_text(page, model, {}, {})[0] == SHORT.get(name, WHOLE)


def test_training_is_repeatable_and_needs_no_rows():
    kit = page_kit.labelled_pages(40)
    assert pages.train(kit, rounds=20) == pages.train(kit, rounds=20)
    empty = pages.train([])
    assert pages.main_text("<p>a</p>", empty, {}, {}) == ("", 1, 0) and pages.train([("", "")]) == empty


def test_sample_of_labelled_pages(spark):
    df = spark.createDataFrame([("<p>a</p>", "a"), (None, "x"), ("<p>" + "b" * 5000, "b"), ("<p>c", "c"), ("<p>c", None)], "html string, text string")
    assert sorted(pages.sample(df, most_pages=10, most_chars=1000)) == [("<p>a</p>", "a"), ("<p>c", "c")]
    assert len(pages.sample(df, most_pages=1, most_chars=1000)) == 1


def test_query_on_given_pages(spark, sf):
    """The given pages mark their article: all of it, and nothing else, is found."""
    got = registry.op12_crf_pages(spark, sf).collect()
    raw = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(raw)
    for r in got:
        url, page = raw[r.page_id]
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>", inner)]
        want = "\n".join(x for x in lines if x)
        assert (r.url, r.text, r.n_chars) == (url, want, len(want))


def test_query_on_odd_rows(spark, tmp_path):
    rows = [
        (1, "u", None), (1, "u", ""), (2, None, "<p>"), (None, "u", "<html><body><article><p>One sentence here. And another one.</p></article>"),
        (3, "u", "<article>" + "<p>" + "long words here. " * 20_000 + "</article>"), (4, "u", "<nav><a href=/>menu</a></nav>")
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, main string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.n_chars): r.text for r in registry.op12_crf_pages(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "", (2, 0): "", (None, 35): "One sentence here. And another one.", (3, 339_999): ("long words here. " * 20_000).strip(), (4, 0): ""}
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert registry.op12_crf_pages(spark, f"{tmp_path}/none").count() == 0
    assert pages.extract(df, pages.train([])).columns == ["page_id", "url", "html", "main"]

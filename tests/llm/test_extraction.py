"""Main text: layouts with known text, the scan against brute force, odd markup, the weight of the weights."""

import random
import re
import time

from fathomline.llm.extraction import BLOCKS, Model, best_run, default_model, extracted, labelled, labelled_pages, main_text, sequence

MODEL = default_model()
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><a href="/">home</a></nav><div class="cookie-notice">We use cookies and more words than the article</div>
<div class="wrap"><article><header><h1>The &amp; title</h1></header><p>First
 block&nbsp;here<br>goes on.<p>Second <b>bold<p><div class="ad">buy now</div>Third &lt;x&gt;</p><form>mail <input></form>
<section class="comments"><p>reader one</p></section><!-- hidden > text --></article><aside>related words</aside></div>
<div id="sidebar">other</div><footer>&copy; foot</footer></body></html>"""


ARTICLE = "<h1>The title</h1><p>First paragraph with some words here, and more.</p><p>Second one <b>is</b> shorter.</p><p>End.</p>"
TEXT = "The title\nFirst paragraph with some words here, and more.\nSecond one is shorter.\nEnd."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Example company</footer>"
LAYOUTS = {
    "sidebar in a wrapper's name": f'{NAV}<div class="content-sidebar-wrap"><main><article>{ARTICLE}</article></main><aside>Side words</aside></div>{FOOT}',
    "has-sidebar": f'{NAV}<div class="has-sidebar"><article>{ARTICLE}</article></div>{FOOT}',
    "search and login in a wrapper's name": f'{NAV}<div class="search-results-page login-required"><div class="post">{ARTICLE}</div></div>{FOOT}',
    "one form around the page": f'<form method="post" id="aspnetForm">{NAV}<div class="content">{ARTICLE}</div>{FOOT}</form>',
    "entry-header": f'{NAV}<article><div class="entry-header"><h1>The title</h1></div>{ARTICLE[18:]}</article>{FOOT}',
    "nothing else": ARTICLE,
    "tables": f"<table><tr><td>{NAV}</td><td>{ARTICLE}</td></tr></table>",
    "parts inside": f'<article><h1>The title</h1><div class="ad-slot">Buy our stuff now and get many more things than you ever wanted</div>{ARTICLE[18:]}<section class="comments"><h2>2 comments</h2><p>I like it a lot, and wrote a long comment to say so in many words.</p></section></article>{FOOT}',
    "unknown names": f'<header><a href="/">Logo</a></header><div id="x1"><div id="x2">{ARTICLE}</div></div><div class="cookie-consent">We use cookies, and many words to say it with. Accept all?</div>{FOOT}',
}


def test_known_layouts():
    assert main_text(PAGE, MODEL) == "The & title\nFirst block here goes on.\nSecond bold\nThird <x>"
    for name, body in LAYOUTS.items():
        for page in (f"<html><head><title>T</title></head><body>{body}</body></html>", f'<!doctype html><body class="home search-results login">{body}'):
            assert main_text(page, MODEL) == TEXT, name


def lines(items, held):
    """Brute force: the held items' text, block by block."""
    out = [""]
    for (tag, text, _), own in zip(items, held, strict=True):
        if tag.lstrip("/") in BLOCKS:
            out.append("")
        elif tag == "br":
            out[-1] += " "
        elif own or (not tag and text.isspace()):
            out[-1] += text
    return "\n".join(x for x in (" ".join(x.split()) for x in out) if x)


def test_held_out_pages():
    whole = common = found = same = 0
    pages = labelled_pages(200, seed=99)
    for page in pages:
        items, _, main = labelled(page)
        want, got = lines(items, main), main_text(re.sub(r" data-(main|aside)", "", page), MODEL)
        a, b = want.split(), got.split()
        whole, found, common, same = whole + len(a), found + len(b), common + len(a) - sum((x in a and a.count(x) > b.count(x)) * (a.count(x) - b.count(x)) for x in set(a)), same + (want == got)
    assert common > 0.98 * whole and common > 0.98 * found and same > 0.85 * len(pages)


def test_result_is_the_best_run_by_brute_force():
    rng = random.Random(5)
    pages = [x for x in labelled_pages(150, seed=7) if len(sequence(x)[0]) < 150][:40]
    assert len(pages) > 20
    for page in pages:
        model = Model({k: w + rng.gauss(0, 0.3) for k, w in MODEL.weights.items()}, MODEL.tags)
        items, nodes = sequence(page)
        scores = model.scored(items, nodes)
        runs = [(sum(scores[i : j + 1]), -i, j) for i in range(len(items)) for j in range(i, len(items))]
        total, first, last = max(runs, key=lambda x: (round(x[0], 9), x[1], -x[2]))
        first = -first
        while total > 0 and first and items[first - 1][0].lstrip("/") not in BLOCKS:
            first -= 1
        while total > 0 and last + 1 < len(items) and items[last + 1][0].lstrip("/") not in BLOCKS:
            last += 1
        held = [total > 0 and first <= i <= last and scores[i] > 0 for i in range(len(items))]
        assert main_text(page, model) == lines(items, held)


def test_weights_decide():
    page = f"<html><body>{LAYOUTS['parts inside']}</body></html>"
    flat = Model({"": 2.0}, {"*": -0.01})
    assert "Buy our stuff" in main_text(page, flat) and "Example company" in main_text(page, flat)
    assert main_text(page, Model(MODEL.weights, {"*": -20.0})).count("\n") == 0
    assert main_text(page, Model({"": -5.0}, MODEL.tags)) == ""


def test_odd_markup():
    for page, text in (("", ""), ("<p>", ""), ("plain a < b", "plain a < b"), ("<article><p>cut &am", "cut &am"), ("<article><p>t</p><p cla", "t"), ("<script>x", ""), ('<p title="a>b">y</p>', "y"), ("<p>é x", "é x"), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"), ('<p title="' + "x>" * 5000 + '">main words here</p>', "main words here"), ("<article><p>x <math><mi>y</mi></math> z</p></article>", "x y z")):
        assert main_text(page, MODEL) == text


def test_time_grows_with_the_page():
    for page in ("<div>" * 50_000 + "x", "<b>x" * 50_000, "<div><p>word word" * 20_000, '<a "' * 100_000, "<script>" * 50_000, "<p>word " * 100_000):
        began = time.time()
        main_text(page, MODEL)
        assert time.time() - began < 10


def test_scan_finds_the_best_run():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randint(-4, 4) for _ in range(rng.randint(1, 14))]
        first, last = best_run(x)
        assert sum(x[first : last + 1]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_table(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "<p>word " * 20000, "t"), (1, "u", PAGE, "t")]
    found = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == 4 and [x.n_chars for x in found] == [len(x.text) for x in found]
    assert {(x.page_id, x.url, x.text[:8]) for x in found} == {(1, "u", "The & ti"), (2, None, ""), (None, "v", "word\nwor")}
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

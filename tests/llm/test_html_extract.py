import random
import time

import numpy as np

from phasegrid.llm import html_extract as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies on this site, accept them please.</div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, cheap and good.</div>
<article><h1>A &amp; B</h1><p>First   paragraph\n of the <b>story</b>, it goes on &eacute;.<p>Second one &lt;here&gt;.</p>
<aside class="related"><p>Read also this other article of ours.</p></aside><ul><li>point one</li><li>point two</li></ul></article>
<div id="comments"><p>I am a reader and I do not agree with a word of this, sorry.</p></div>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_a_page():
    assert op.main_text(PAGE, op.model()) == "A & B\nFirst paragraph of the story, it goes on é.\nSecond one <here>.\npoint one\npoint two"


def test_held_out_pages():
    right = total = 0
    for page, labels in op.labelled_pages(200, 4242):
        found = op.model().decode(op.page_features(page))
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_equals_trying_all_labellings():
    r = np.random.default_rng(0)
    crf = op.Crf(r.normal(size=(len(op._FEATURES), 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 8):
        rows = [list(r.integers(0, len(op._FEATURES), 4)) for _ in range(n)]

        def score(y):
            s = crf.start[y[0]] + sum(crf.emit[i, y[t]] for t, row in enumerate(rows) for i in row)
            return s + sum(crf.move[a, b] for a, b in zip(y, y[1:]))

        best = max(score([k >> t & 1 for t in range(n)]) for k in range(1 << n))
        assert abs(score(crf.decode(rows)) - best) < 1e-9


def test_training_is_repeatable():
    pages = op.labelled_pages(30, 1)
    a, b = op.train(pages, steps=10), op.train(pages, steps=10)
    assert np.array_equal(a.emit, b.emit)


def test_broken_markup():
    r = random.Random(1)
    for _ in range(300):
        cut = PAGE[: r.randint(0, len(PAGE))]
        noise = "".join(r.choice("<>/p =\"'&;a!-") for _ in range(r.randint(0, 40)))
        op.main_text(cut + noise, op.model())
    text = op.main_text("<article><h1>Title here</h1><p>Some text that ends in the middle of a tag.</p><p cla", op.model())
    assert text == "Title here\nSome text that ends in the middle of a tag."


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (2, None, None, None, None), (3, "u", "", "", 0), (None, "u", "<p>", "", 0), (4, "u", "<p>" + "word " * 50_000, "", 0)]
    found = op.extracted(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 6 and found[0] == found[1]
    by = {r.page_id: r for r in found}
    assert (by[2].text, by[2].n_chars, by[3].text, by[None].text) == ("", 0, "", "")
    assert by[1].n_chars == len(by[1].text) > 0
    assert by[4].text == ("word " * 50_000).strip() and by[4].n_chars == 249_999
    assert op.extracted(spark.createDataFrame([], schema)).collect() == []


def test_open_and_self_closed_elements_lose_no_text():
    texts = lambda h: [b.text for b in op.blocks(h)]
    assert texts("<head><title>t</title><body><article><p>Main text.") == ["Main text."]
    assert texts("<html><head><meta charset=x><title>a < b</title><style>p{}</style><!-- <p> --><script>'<p>'</script><p>Main") == ["Main"]
    assert texts("<head><noscript><img src=x></noscript><link href=y></head><p>Main") == ["Main"]
    assert texts('<p>a<svg aria-label="x>y"/><p>b<svg><title>no</title></svg><p>c') == ["a", "b", "c"]
    assert texts("<p>a<svg><g><svg>no</svg>no</g></svg><p>b") == ["a", "b"]
    for name in ("iframe", "svg", "noscript", "template"):
        assert texts(f"<p>a</p><{name} id=x><p>b</p><{name}>no</{name}><p>c") == ["a", "b", "c"]
    assert texts("<p>a<iframe src=x /><p>b") == ["a", "b"]
    assert texts("<p>a<select><option>no<option>no<p>b") == ["a", "b"]
    assert texts("<p>a<svg-icon>b</svg-icon>") == ["a", "b"]
    for name in ("script", "style", "textarea"):
        assert texts(f"<p>a<{name}>no<p>no") == ["a"]
    page = PAGE.replace("</head>", "").replace("<nav>", "<svg/><iframe src=x><nav>")
    assert op.main_text(page, op.model()) == op.main_text(PAGE, op.model()) != ""


P1 = "When the council met on Tuesday, it had only one question before it, and it took four hours to answer."
P2 = "The answer, in short, was yes, though nobody who voted for it wanted to say so on the record."
MAIN = f"<h1>Council says yes</h1><p>{P1}</p><p>{P2}</p>"
WANTED = f"Council says yes\n{P1}\n{P2}"
#: Pages whose templates and names none of the training pages has.
TEMPLATES = {
    "head left open": f"<html><head><title>x</title><body><article>{MAIN}</article>",
    "noscript left open": f"<html><head></head><body><noscript><img src=x><article>{MAIN}</article>",
    "site": f'<body><div class="site"><div class="site-content">{MAIN}</div></div>',
    "site with article": f'<body><div class="site"><div class="site-content"><article>{MAIN}</article></div></div>',
    "names on the body": f'<body class="single-post sidebar-right"><article>{MAIN}</article>',
    "article header": f"<body><article><header><h1>Council says yes</h1></header><p>{P1}</p><p>{P2}</p></article>",
    "post header": f'<body><div class="post"><div class="post-header"><h1>Council says yes</h1></div><p>{P1}</p><p>{P2}</p></div>',
    "apostrophe outside quotes": f"<body><article><h1>Council says yes</h1><p title=don't>{P1}</p><p>{P2} <b>It's so.</b></p></article>",
    "layout": f'<body><div class="layout-with-sidebar"><div class="main-column">{MAIN}</div><div class="sidebar"><p>Related: another story that you should read now.</p></div></div>',
    "blog theme": f"""<body class="home has-sidebar"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding">
        <p class="site-title">The Valley Post</p></div><nav id="site-navigation"><ul class="menu"><li><a href="/">Home</a></li></ul></nav></header><div id="content" class="site-content">
        <div id="primary" class="content-area"><main class="site-main"><article class="post type-post"><header class="entry-header"><h1 class="entry-title">Council says yes</h1>
        <div class="entry-meta">Posted on 3 May 2021 by admin</div></header><div class="entry-content"><p>{P1}</p><p>{P2}</p></div><footer class="entry-footer">Posted in <a href="/x">Politics</a></footer>
        </article><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><div class="comment-content">
        <p>I was there and it was not like this at all.</p></div></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent posts</h2>
        <ul><li><a href="/p1">Bridge closed again</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by something</div></footer></div>""",
    "responses": f"""<body><div id="root"><div class="metabar"><a href="/">Home</a><a href="/in">Sign in</a></div><div class="postArticle"><section><div class="section-inner">{MAIN}</div></section></div>
        <div class="responsesWrapper"><h3>Responses</h3><div class="response"><p>I was there and it was not like this at all.</p></div></div></div>""",
    "tables": f"""<body bgcolor=white><table width=100%><tr><td class="leftmenu"><a href="a">Home</a><br><a href="b">News</a></td><td class="text"><h1>Council says yes</h1>{P1}<p>{P2}</td></tr></table>
        <div id="copyright">Copyright 1999 The Valley Post</div>""",
}


def test_templates_never_trained_on():
    found = {k: op.main_text(h, op.model()).replace(" It's so.", "") for k, h in TEMPLATES.items()}
    assert found == dict.fromkeys(TEMPLATES, WANTED)


def test_references_are_decoded_one_text_at_a_time():
    assert [b.text for b in op.blocks("<p>AT&am<b>p;</b>T &amp;lt; A&amp;B &eacute;")] == ["AT&amp;T &lt; A&B é"]


def test_time_grows_with_length_not_with_nesting():
    n = 40_000
    for page in ("<div><a>" * n + "x" + "</a></div>" * n, "<i><div>" + "<b>" * n + "x" + "</i>" * n, "<div>" * n + "x" + "</section>" * n, "<div class=content>" * n + "x<p>" * n):
        began = time.time()
        assert len(op.blocks(page)) in (1, n)
        assert time.time() - began < 10

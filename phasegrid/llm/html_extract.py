"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags), each with features of its ancestors (tags, hints
in class, id and role), of its own tag and of its text (length, link share, marks). A hint on an element that holds half
of the page's text or more is a feature of its own, since wrappers are often named for what they hold beside the article
(``has-sidebar``); so are headers and footers inside an article. Names of ``html`` and ``body`` say nothing. The chain has
two labels, content and other; it is trained by gradient ascent on the penalised log-likelihood over labelled pages and
decoded by Viterbi.

*Training pages* are made here, by ``labelled_page``: templates of news pages, blogs and forums with menus, headers,
footers, sidebars, notices, adverts, forms, comments and articles of random words, with and without telling class names,
under plain and theme-like wrappers, with and without article headers, some of them cut off. Their number is ``TRAIN_PAGES``; training is seeded and takes a few seconds on the driver. The
weights (one row a feature) are broadcast; pages are decoded where they are read.

Defined cases: a null or empty html has the empty text; so has a page without content blocks; markup that ends in the
middle of a tag loses that tag; elements left open end with the page; comments, scripts, styles and other raw text are
no blocks, but of raw text only a script, style or text area left open takes the rest of the page; a page of any length is
read whole, in time that grows with its length; ties in decoding go to content; null ids and repeated rows are rows like
any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAIN_PAGES = 700
SEED = 11
_RAW = "script|style|noscript|template|textarea|iframe|svg|head|select"
#: Up to the end of a tag; quotes quote only after an equals sign.
_ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_SKIPPED = r"<!--.*?(?:-->|\Z)|<({})(?![\w:-])[^>]*>.*?(?:</\1\s*>|\Z)"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?![\w:-])({_ATTRIBUTES}>)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_PAIRS = {
    name: re.compile(_SKIPPED.format("script|style|textarea") + rf"|<(/?){name}(?![\w:-])({_ATTRIBUTES}>)", re.S | re.I)
    for name in ("noscript", "template", "iframe", "svg", "select")
}
_TO_END = {name: re.compile(rf".*?(?:</{name}\s*>|\Z)", re.S | re.I) for name in ("script", "style", "textarea")}
#: What a head may hold, one thing at a time.
_IN_HEAD = re.compile(
    r"\s+|" + _SKIPPED.format("script|style") + r"|<[!?][^>]*>|<title(?![\w:-])[^>]*>(?:(?:(?!</?(?:title|head|body|svg)(?![\w:-])).)*+</title\s*>|[^<]*)"
    r"|</?(?:meta|link|base|basefont|bgsound|title|head|html|noscript|template)(?![\w:-])[^>]*>",
    re.S | re.I,
)
_OPTIONS = re.compile(r"(?:\s*<(?:option|optgroup)(?![\w:-])[^>]*>[^<]*|\s*</(?:option|optgroup)\s*>)*+", re.I)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre hr figure fieldset".split()},
}
_SCOPES = frozenset("body div section article main aside header footer nav form ul ol table td blockquote figure fieldset".split())
_ANCESTORS = frozenset(
    "article main nav header footer aside form ul ol li table section blockquote pre figure figcaption details dialog fieldset button".split()
)
_HINTS = {
    word: group
    for group, words in {
        "ad": "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored dfp outbrain taboola",
        "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
        "talk": "comment comments commentlist reply replies respond response responses disqus discussion thread reader readers",
        "side": "sidebar side widget widgets related complementary aside recommended recommendations popular trending more rail",
        "foot": "footer foot copyright legal contentinfo colophon imprint bottom",
        "head": "header masthead topbar branding logo tagline",
        "note": "cookie cookies consent notice notices alert warning gdpr popup modal overlay newsletter subscribe paywall login signup message",
        "share": "share sharing social follow tags byline meta author",
        "body": "article articlebody post entry content main story text body prose",
    }.items()
    for word in words.split()
}


#: Words by which a name tells of its element's neighbours, not of its content.
_ABOUT = frozenset("has with without no layout".split())


class Element:
    """An element that says something of the blocks inside it: its marks, the next such one around it, its text."""

    __slots__ = ("marks", "around", "start", "chars", "path")

    def __init__(self, marks: tuple[str, ...], around: Element | None, start: int):
        self.marks, self.around, self.start, self.chars, self.path = marks, around, start, 0, frozenset()

    def place(self, total: int) -> None:
        """Set the features of the blocks inside; those around must be placed."""
        before = self.around.path if self.around else frozenset()
        inner = not before.isdisjoint(("in:article", "in:main", "hint:body"))
        out = set(before)
        for kind, name in (m.split(":") for m in self.marks):
            if kind == "hint" and name != "body" and 2 * self.chars >= total:
                out.add(f"wide:{name}")
            elif inner and name in _INNER:
                out.add(f"inner:{name}")
            else:
                out.add(f"{kind}:{name}")
        self.path = frozenset(out)


class Block:
    """A leaf block: its text and what is known of it."""

    __slots__ = ("text", "tag", "around", "linked")

    def __init__(self, text: str, tag: str, around: Element | None, linked: float):
        self.text, self.tag, self.around, self.linked = text, tag, around, linked

    @property
    def path(self) -> frozenset:
        return self.around.path if self.around else frozenset()


#: Endings of words written together (``leftmenu``).
_ENDINGS = ("menu", "nav", "navbar", "header", "footer", "sidebar", "comments", "content", "banner", "article")


@lru_cache(maxsize=10_000)
def _hints(token: str) -> frozenset:
    """The hints of one name. Of its words those that name other parts go before the article's."""
    words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
    if not _ABOUT.isdisjoint(words):
        return frozenset()
    known = (w if w in _HINTS else next((e for e in _ENDINGS if w.endswith(e)), "") for w in words)
    groups = {_HINTS[w] for w in known if w}
    return frozenset(f"hint:{g}" for g in (groups - {"body"} or groups))


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """What an element says of the blocks inside it."""
    out = {f"in:{name}"} if name in _ANCESTORS else set()
    if "=" in attributes and name not in ("html", "body"):
        for m in _ATTR.finditer(attributes):
            for token in (m.group(1) or m.group(2) or m.group(3) or "").split():
                out |= _hints(token)
    return tuple(sorted(out))


def _tags(html: str) -> Iterator[tuple[re.Match, int]]:
    """Every tag, comment or raw element of a page, and where it ends.

    Scripts, styles and text areas run to their closing tag or the end of the page. Others that are no blocks end at
    theirs, if they have one; if not, or closed by themselves, they are their opening tag alone (a select with its
    options). A head ends at the first thing that no head holds: its closing tag may be left out.
    """
    closed: dict[str, dict[int, int]] = {}

    def end_of(name: str, start: int) -> int | None:
        """End of the element that opens there; a closing tag belongs to the last one open."""
        if name not in closed:
            closed[name], opened = {}, []
            for m in _PAIRS[name].finditer(html):
                if m.group(3) is None or m.group(1):
                    continue
                if m.group(2):
                    if opened:
                        closed[name][opened.pop()] = m.end()
                elif not m.group(3).endswith("/>"):
                    opened.append(m.start())
        return closed[name].get(start)

    at = 0
    while m := _TAG.search(html, at):
        at = m.end()
        name = (m.group(1) or "").lower()
        if name in _TO_END:
            at = _TO_END[name].match(html, at).end()
        elif name == "head":
            while inside := _IN_HEAD.match(html, at):
                outer = re.match(r"<(noscript|template)\b", inside.group(), re.I)
                at = outer and end_of(outer.group(1).lower(), inside.start()) or inside.end()
        elif name:
            end = end_of(name, m.start())
            at = end or (_OPTIONS.match(html, at).end() if name == "select" else at)
        yield m, at


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page with text, in page order. Time grows with the page's length, not with its nesting."""
    html = html or ""
    stack: list[tuple[str, Element | None, bool]] = []  # name, the nearest element with marks, whether that is this one
    at_name: dict[str, list[int]] = {}  # places in the stack
    at_block: list[int] = []
    at_scope: list[int] = []
    elements: list[Element] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = total = whole = 0

    def flush() -> None:
        nonlocal parts, linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag = stack[at_block[-1]][0] if at_block else ""
                out.append(Block(text, tag, stack[-1][1] if stack else None, linked / max(total, 1)))
            parts, linked, total = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, total, whole
        if text:
            if "&" in text:
                text = html_lib.unescape(text)
            parts.append(text)
            total += len(text)
            whole += len(text.strip())
            if at_name.get("a"):
                linked += len(text)

    def close(to: int) -> None:
        while len(stack) > to:
            name, element, own = stack.pop()
            at_name[name].pop()
            for places in (at_block, at_scope):
                if places and places[-1] == len(stack):
                    places.pop()
            if own:
                element.chars = whole - element.start

    at = 0
    for m, end in _tags(html):
        add(html[at : m.start()])
        at = end
        name = m.group(4)
        if name is None:
            if m.group(1) and m.group(1).lower() == "select":
                flush()
            continue
        name = name.lower()
        if m.group(3):
            if name not in _INLINE:
                flush()
            if at_name.get(name) and (name not in _INLINE or not at_block or at_name[name][-1] > at_block[-1]):
                close(at_name[name][-1])
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE:
            flush()
            inside = at_scope[-1] if at_scope else -1
            ended = max((at_name[t][-1] for t in _CLOSES.get(name, ()) if at_name.get(t)), default=-1)
            if ended >= 0 and ended >= inside:
                close(ended)
        if name in _VOID or m.group(5).rstrip().endswith("/") and name not in _SCOPES:
            continue
        around = stack[-1][1] if stack else None
        marks = _marks(name, m.group(5))
        if marks:
            elements.append(Element(marks, around, whole))
        at_name.setdefault(name, []).append(len(stack))
        if name not in _INLINE:
            at_block.append(len(stack))
        if name in _SCOPES:
            at_scope.append(len(stack))
        stack.append((name, elements[-1] if marks else around, bool(marks)))
    add(html[at:])
    flush()
    close(0)
    for element in elements:
        element.place(whole)
    return out


_GROUPS = sorted(set(_HINTS.values()))
_INNER = ("header", "footer", "head", "foot", "share")
_FEATURES: list[str] = (
    ["bias"]
    + [f"in:{t}" for t in sorted(_ANCESTORS)]
    + [f"hint:{g}" for g in _GROUPS]
    + [f"wide:{g}" for g in _GROUPS if g != "body"]
    + [f"inner:{g}" for g in _INNER]
    + [f"tag:{t}" for t in "p h1 h2 h3 h4 h5 h6 li div td th dt dd blockquote pre figcaption section article body button other".split()]
    + [f"words:{i}" for i in range(7)]
    + [f"linked:{i}" for i in range(4)]
    + ["stop", "sign", "bar", "digits", "marked", "plain", "plain+body", "article-clean", "main-clean", "first", "last"]
)
_AT = {f: i for i, f in enumerate(_FEATURES)}
_BAD = ("hint:ad", "hint:menu", "hint:talk", "hint:side", "hint:foot", "hint:head", "hint:note", "hint:share", "in:nav", "in:aside", "in:footer", "in:form", "in:header", "in:dialog", "in:button")


def _features(b: Block, first: bool, last: bool) -> list[int]:
    n = b.text.count(" ") + 1
    bad = any(x in b.path for x in _BAD)
    names = ["bias", *b.path, f"tag:{b.tag}" if f"tag:{b.tag}" in _AT else "tag:other"]
    names.append(f"words:{0 if n < 2 else 1 if n < 4 else 2 if n < 8 else 3 if n < 16 else 4 if n < 32 else 5 if n < 80 else 6}")
    names.append(f"linked:{0 if b.linked < 0.05 else 1 if b.linked < 0.4 else 2 if b.linked < 0.9 else 3}")
    if b.text[-1] in ".!?…\"”":
        names.append("stop")
    if b.text[0] in "©®" or "©" in b.text:
        names.append("sign")
    if "|" in b.text or "·" in b.text or "»" in b.text:
        names.append("bar")
    if sum(map(b.text.count, "0123456789")) * 10 > len(b.text):
        names.append("digits")
    if bad:
        names.append("marked")
    else:
        names.append("plain")
        if "hint:body" in b.path:
            names.append("plain+body")
        if "in:article" in b.path:
            names.append("article-clean")
        if "in:main" in b.path:
            names.append("main-clean")
    if first:
        names.append("first")
    if last:
        names.append("last")
    return [_AT[x] for x in names]


def page_features(page: list[Block]) -> list[list[int]]:
    return [_features(b, i == 0, i == len(page) - 1) for i, b in enumerate(page)]


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """(html, label of each leaf block: 1 content, 0 other) of a made-up page."""
    letters = "aeioubcdfghlmnprst"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a, b: some(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ""])
    out: list[str] = []
    labels: list[int] = []

    def put(tag: str, text: str, label: int, inner: str = "{}") -> None:
        out.append(f"<{tag}>{inner.format(text)}</{tag.split()[0]}>")
        labels.append(label)

    def mark(names: str) -> str:
        return f' class="{r.choice(names.split())}"' if r.random() < 0.8 else ""

    def menu(tag: str, attributes: str) -> None:
        out.append(f"<{tag}{attributes}><ul>")
        for _ in range(r.randint(2, 8)):
            put("li", some(1, 2), 0, '<a href="#">{}</a>')
        out.append(f"</ul></{tag}>")

    def boilerplate(kind: str) -> None:
        if kind == "nav":
            menu(*r.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="menu"'), ("div", ' id="navigation"'), ("header", "")]))
        elif kind == "ad":
            put("div" + r.choice([' class="ad"', ' class="advert"', ' id="banner"', ' class="sponsored"']), sentence(3, 14), 0)
        elif kind == "notice":
            put("div" + r.choice([' class="cookie-notice"', ' class="alert"', ' role="alert" class="notice"', ' id="newsletter"']), sentence(5, 25), 0)
        elif kind == "header":
            out.append(r.choice(["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">']))
            tag = "header" if out[-1].startswith("<header") else "div"
            put(r.choice(["h1", "div", "p", "h2"]), some(1, 5), 0)
            if r.random() < 0.5:
                put("p", sentence(3, 9), 0)
            out.append(f"</{tag}>")
        elif kind == "footer":
            tag, attributes = r.choice([("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"'), ("footer", ' class="site"')])
            out.append(f"<{tag}{attributes}>")
            if r.random() < 0.5:
                out.append("&copy; " + word() + ".example.org &middot; " + sentence(2, 14))
                labels.append(0)
            for _ in range(r.randint(0, 2)):
                put("p", r.choice(["© 2021 ", ""]) + sentence(2, 20), 0)
            out.append(f"</{tag}>")
        elif kind == "side":
            tag, attributes = r.choice([("aside", ""), ("div", ' class="sidebar"'), ("div", ' class="related"'), ("section", ' class="widget"')])
            out.append(f"<{tag}{attributes}>")
            if r.random() < 0.7:
                put(r.choice(["h2", "h3", "h4"]), some(1, 4), 0)
            for _ in range(r.randint(1, 5)):
                put(r.choice(["p", "p", "li", "div"]), sentence(3, 30), 0, r.choice(["{}", '<a href="#">{}</a>']))
            out.append(f"</{tag}>")
        elif kind == "form":
            out.append(f"<form{mark('search login subscribe x')}>")
            put("label", some(1, 3), 0)
            put("button", some(1, 2), 0)
            out.append("</form>")
            # label is inline: it joins the button's block only if no block tag parts them, and button does
        elif kind == "talk":
            tag = r.choice(["div", "section", "ol"])
            out.append(f"<{tag}{r.choice([' class=\"comments\"', ' id=\"comments\"', ' class=\"comment-list\"', ' class=\"discussion\"'])}>")
            for _ in range(r.randint(1, 5)):
                put("div class=\"comment\"" if r.random() < 0.5 else "p", sentence(3, 60), 0)
            out.append(f"</{tag}>")

    def article() -> None:
        tag, attributes = r.choice(
            [("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", "")]
        )
        outer = r.random() < 0.2
        out.append("<main>" * outer + f"<{tag}{attributes}>")
        head = r.random()
        if head < 0.25 and (tag in ("article", "main") or attributes):
            own, name = r.choice([("header", ""), ("header", ' class="entry-header"'), ("div", ' class="post-header"'), ("div", ' class="article-head header"')])
            out.append(f"<{own}{name}>")
            put("h1", some(1, 12), 1)
            if r.random() < 0.5:
                put("p", sentence(8, 25), 1)
            if r.random() < 0.6:
                put(r.choice(['div class="byline"', 'p class="meta"', 'div class="entry-meta"']), "By " + some(1, 3) + r.choice(["", ", 3 May 2021", " · 12:30"]), 0)
            out.append(f"</{own}>")
        elif head < 0.9:
            put(r.choice(["h1", "h1", "h2"]), some(1, 12), 1)
        wrapped = r.random() < 0.2 and bool(attributes)
        out.append('<div class="entry-content">' * wrapped)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.68:
                text = sentence(*r.choice([(1, 2), (2, 6), (5, 30), (20, 90)]))
                inner = r.choice(["{}", "{}", "<b>{}", "<em>{}</em>", '{} <a href="#">' + word() + "</a>"])
                if r.random() < 0.2:
                    out.append("<p>" + inner.format(text) + r.choice(["", "<br>"]))  # left open
                    labels.append(1)
                else:
                    put("p", text, 1, inner)
            elif x < 0.74:
                put(r.choice(["h2", "h3"]), some(1, 7), 1)
            elif x < 0.81:
                out.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    put("li", sentence(1, 20), 1)
                out.append("</ul>")
            elif x < 0.85:
                put("blockquote", sentence(5, 40), 1)
            elif x < 0.88:
                put("pre", some(2, 20), 1)
            elif x < 0.9:
                out.append("<table><tr>")
                for _ in range(r.randint(1, 3)):
                    put("td", some(1, 4), 1)
                out.append("</tr></table>")
            elif x < 0.97:
                boilerplate(r.choice(["ad", "side", "side", "form", "notice", "ad"]))
            else:
                put("div", sentence(5, 40), 1)
        out.append("</div>" * wrapped)
        if r.random() < 0.2 and (tag in ("article", "main") or attributes):
            own, name = r.choice([("footer", ""), ("footer", ' class="entry-footer"'), ("div", ' class="post-footer"'), ("div", ' class="tags"'), ("div", ' class="share"')])
            out.append(f"<{own}{name}>")
            for _ in range(r.randint(1, 3)):
                put(r.choice(["p", "div", "span"]) if own != "div" or r.random() < 0.5 else "p", some(1, 4), 0, r.choice(["{}", '<a href="#">{}</a>', 'Posted in <a href="#">{}</a>']))
            out.append(f"</{own}>")
        if r.random() < 0.15:
            boilerplate("talk")
        out.append(f"</{tag}>" + "</main>" * outer)

    out.append(f"<!DOCTYPE html><html><head><title>{some(1, 6)}</title><script>var t='</p>';</script></head><body>")
    if r.random() < 0.06:  # an article and nothing else
        for _ in range(r.choice([1, 1, 2, 4])):
            put("p", sentence(*r.choice([(8, 30), (20, 90), (80, 200)])), 1)
        return "".join(out), labels
    wrappers = []
    if r.random() < 0.4:
        for _ in range(r.randint(1, 3)):
            wrappers.append(r.choice("site page wrapper container hfeed layout-with-sidebar has-sidebar content-sidebar-wrap sidebar-right right-sidebar header-fixed nav-open menu-closed ads-enabled cookie-banner-shown widget-layout post-and-sidebar with-related footer-bottom site-content content-area main-wrap content".split()))
        out.append("".join(f'<div class="{w}">' for w in wrappers[:-1]))
    for kind in r.sample(["header", "nav", "notice", "ad"], r.randint(1, 4)):
        boilerplate(kind)
    if wrappers:
        out.append(f'<div class="{wrappers[-1]}">')
    if r.random() < 0.25:
        boilerplate("side")
    article()
    if r.random() < 0.12:
        return "".join(out).removesuffix("</main>").rpartition("</")[0], labels
    for k, kind in enumerate(r.sample(["talk", "side", "form", "ad", "nav"], r.randint(0, 3))):
        if wrappers and not k and r.random() < 0.5:
            out.append("</div>")
        boilerplate(kind)
    boilerplate("footer")
    out.append("</body></html>")
    return "".join(out), labels


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Made-up pages whose blocks and labels agree in number (a few whose markup runs two blocks together are left out)."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        page, labels = labelled_page(r)
        found = blocks(page)
        if len(found) == len(labels):
            out.append((found, labels))
    return out


class Crf:
    """Weights of a two-label chain: emissions by feature, transitions, start."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The labels of highest joint score (Viterbi); ties go to content."""
        if not rows:
            return []
        w, (m00, m01), (m10, m11) = self._rows(), *self.move.tolist()
        s = [sum(c) for c in zip(*(w[i] for i in rows[0]))]
        a, b = s[0] + self.start[0], s[1] + self.start[1]
        back = []
        for row in rows[1:]:
            s0 = s1 = 0.0
            for i in row:
                x, y = w[i]
                s0 += x
                s1 += y
            f0, f1 = b + m10 >= a + m00, b + m11 >= a + m01
            a, b = s0 + (b + m10 if f0 else a + m00), s1 + (b + m11 if f1 else a + m01)
            back.append((f0, f1))
        label = int(b >= a)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return out[::-1]

    def _rows(self) -> list[tuple[float, float]]:
        if not hasattr(self, "_w"):
            self._w = [tuple(r) for r in self.emit.tolist()]
        return self._w


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, rate: float = 0.15, penalty: float = 0.004) -> Crf:
    """Fit the chain by Adam on the penalised log-likelihood; pages are padded to one length and run together."""
    longest, n, f = max(len(p) for p, _ in pages), len(pages), len(_FEATURES)
    x = np.zeros((n, longest, f))
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest))
    for k, (page, labels) in enumerate(pages):
        for t, row in enumerate(page_features(page)):
            x[k, t, row] = 1
        y[k, : len(labels)], mask[k, : len(labels)] = labels, 1
    flat = x.reshape(-1, f)
    params = [np.zeros((f, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(2)[y] * mask[..., None]
    pairs = mask[:, 1:]
    gold_move = np.einsum("nti,ntj->ij", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    for step in range(1, steps + 1):
        emit, move, start = params
        e = (flat @ emit).reshape(n, longest, 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0:1] + move[0], alpha[:, t - 1, 1:2] + move[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t : t + 1] > 0, new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(ahead[:, 0:1] + move[:, 0], ahead[:, 1:2] + move[:, 1])
            beta[:, t] = np.where(mask[:, t + 1 : t + 2] > 0, new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        joint = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        p_move = (np.exp(np.minimum(joint, 0)) * pairs[..., None, None]).sum((0, 1))
        grads = [
            flat.T @ (gold - p).reshape(-1, 2) / n - penalty * emit,
            (gold_move - p_move) / n - penalty * move,
            (gold[:, 0] - p[:, 0]).sum(0) / n - penalty * start,
        ]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(*params)


_MODEL: list[Crf] = []


def model() -> Crf:
    """The process's model, trained when first asked for."""
    if not _MODEL:
        _MODEL.append(train(labelled_pages(TRAIN_PAGES, SEED)))
    return _MODEL[0]


def main_text(html: str | None, crf: Crf) -> str:
    """The content blocks of a page, joined by line feeds."""
    page = blocks(html)
    return "\n".join(b.text for b, label in zip(page, crf.decode(page_features(page))) if label)


def extracted(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(crf or model())
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), shared.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

"""Pages cut into blocks, and pages of many layouts to learn from.

A block is the text between two block-level tags (or line breaks), with the path of
elements that it lies in.  ``rendered`` sets given paragraphs in a random layout with
menus, headers, footers, sidebars, notices, adverts, forms and comments round and
inside the article; the article's texts carry ``MARK``, so that their blocks are known
after parsing.
"""

from __future__ import annotations

import random
import re
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np

from tessera.llm import blstm

MARK = "\ue000"
HIDDEN = {"script", "style", "template", "noscript", "svg", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "area", "embed", "map", "picture", "source", "track",
}
#: Elements that end an open one of their kind, and the elements that this doesn't reach beyond.
SELF_CLOSING = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % slots


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, path slots of it and all round it, path slots of itself alone, whether it closes a block.
        self.open: list[tuple[str, frozenset[int], frozenset[int], bool]] = [("", frozenset(), frozenset(), True)]
        self.found: list[tuple[frozenset[int], str, int]] = []
        self.pieces: list[str] = []
        self.linked = self.links = self.hidden = 0

    def end_block(self) -> None:
        if self.pieces and (text := " ".join("".join(self.pieces).split())):
            at = next(e for e in reversed(self.open) if e[3])
            self.found.append((at[1] | at[2], text, self.linked))
        self.pieces, self.linked = [], 0

    def _drop(self, depth: int) -> None:
        for tag, *_ in self.open[depth:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[depth:]

    def _close(self, tag: str, stop: tuple[str, ...], only_inline: bool) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name, _, _, block = self.open[depth]
            if name == tag:
                self._drop(depth)
                return
            if name in stop or only_inline and block:
                return

    def handle_starttag(self, tag, attrs):
        block = tag not in INLINE | HIDDEN
        if block:
            self.end_block()
        if tag in VOID:
            return
        if tag in SELF_CLOSING:
            self._close(tag, SELF_CLOSING[tag] or ("div", "article", "section", "td", "body"), False)
        elif block and tag in ("div", "ul", "ol", "table", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "aside", "nav", "footer", "header", "main"):
            self._close("p", ("div", "article", "section", "td", "body"), False)  # a paragraph holds no block
        parent = self.open[-1]
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [x.lower() for x in _PARTS.findall(value)]
        inside = parent[1] | {_slot(f"in {x}", blstm.PATHS) for x in names} if block else parent[1]
        own = frozenset({_slot(f"at {x}", blstm.PATHS) for x in names} | {_slot(f"{parent[0]}>{tag}", blstm.PATHS)}) if block else parent[2]
        self.open.append((tag, inside, own, block))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN or tag in ("a",):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        block = tag not in INLINE | HIDDEN
        if block:
            self.end_block()
        if tag not in VOID:
            self._close(tag, (), not block)

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str) -> list[tuple[frozenset[int], str, int]]:
    """(path slots, text, characters in links) of every block of a page, in page order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.found


class Slots(dict):
    """Word -> slot of its hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        slot = self[word] = _slot(word, blstm.WORDS)
        return slot


def features(found: list[tuple[frozenset[int], str, int]], slots: Slots) -> blstm.Page:
    """The numbers that the network reads of a page's blocks."""
    paths, words, shape = [], [], []
    for path, text, linked in found:
        paths.append(sorted(path) or [0])
        split = text.lower().split(" ")
        words.append([slots[w] for w in split])
        n = len(text)
        shape.append((np.log1p(n) / 6, np.log1p(len(split)) / 5, min(1.0, linked / n), text[-1] in ".!?…:;", sum(map(text.count, ",.;:!?")) / n * 8, text[0].isupper(), sum(map(str.isdigit, text[:200])) / min(n, 200)))
    flat = lambda lists: (np.array([x for y in lists for x in y], np.int32), np.array([len(y) for y in lists], np.int32))
    return (*flat(paths), *flat(words), np.array(shape, np.float32).reshape(len(found), blstm.SHAPE))


# Layouts to learn from: tags and names that parts of pages go by, the commonest ones several times.
NAMES = {
    "article": ("article main section div div div td", "content content content article article post entry story text body main article-body post-content entry-content articleText main-content page-content story-body single-post hentry"),
    "menu": ("nav nav div ul div", "nav nav menu menu navbar navigation topnav links breadcrumb breadcrumbs main-menu navLinks toc pagination"),
    "header": ("header header div", "header header header masthead top site-header branding logo page-top topbar siteTitle"),
    "footer": ("footer footer div", "footer footer footer bottom copyright site-footer legal colophon foot page-footer imprint"),
    "sidebar": ("aside aside div section", "sidebar sidebar sidebar sidebar side aside widget related rail right-column left-col recommended popular trending tags share social sideBar more-stories"),
    "advert": ("div div aside section", "ad ad ad ads ads advert advertisement promo sponsor sponsored banner-ad promotion adBox ad-slot teaser"),
    "notice": ("div div section dialog", "notice notice notice cookie cookies consent alert gdpr popup modal newsletter subscribe paywall disclaimer cookie-banner warning info-box message"),
    "form": ("form", "search login signup contact form subscribe-form searchForm"),
    "comments": ("section div div ol", "comments comments comments comments comments comment discussion replies responses disqus comment-list reader-comments commentThread feedback"),
}


def _attributes(r: random.Random, names: str, plain: float) -> str:
    if r.random() < plain:
        return "" if r.random() < 0.6 else f' class="c{r.randint(10, 999)}"'
    name = r.choice(names.split())
    extra = r.choice(["", "", f" x{r.randint(1, 99)}", " wide", " clearfix", " row"])
    return f' id="{name}"' if r.random() < 0.35 else f' class="{name}{extra}"'


def rendered(r: random.Random, article: list[str], prose: list[str]) -> str:
    """A page with the article's paragraphs; all its other texts are made of ``prose``."""
    words = " ".join(r.choice(prose) for _ in range(4)).split() or ["x"]

    def some(least: int, most: int) -> str:
        at, n = r.randrange(len(words)), r.randint(least, most)
        return escape(" ".join(words[at : at + n] or words[:1]))

    def part(kind: str, inner: str, plain: float = 0.0) -> str:
        tags, names = NAMES[kind]
        tag = r.choice(tags.split())
        semantic = tag in ("nav", "header", "footer", "aside", "article", "main", "form")
        return f"<{tag}{_attributes(r, names, 0.7 if semantic else plain)}>{inner}</{tag}>"

    link = lambda: f'<a href="/{r.randint(1, 999)}">{some(1, 3)}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " ", "<br>"]).join(link() for _ in range(n))
    prose_block = lambda most=40: r.choice(["<p>{}</p>", "<div>{}</div>", "{}<br>"]).format(some(3, most))
    heading = lambda: f"<h{(k := r.randint(2, 5))}>{some(1, 5)}</h{k}>"

    def advert() -> str:
        return part("advert", r.choice([prose_block(25), some(2, 20), heading() + prose_block(), link()]))

    def notice() -> str:
        return part("notice", r.choice([some(4, 30), prose_block() + f"<button>{some(1, 2)}</button>", prose_block() + link()]))

    def form() -> str:
        fields = "".join(f"<label>{some(1, 3)}</label><input name=q>" for _ in range(r.randint(1, 3)))
        return part("form", heading() * r.randint(0, 1) + fields + r.choice(["", f"<select><option>{some(1, 2)}<option>{some(1, 2)}</select>", f"<textarea>{some(1, 6)}</textarea>"]) + f"<button>{some(1, 2)}</button>", 0.5)

    def sidebar() -> str:
        return part("sidebar", heading() + r.choice([listed(r.randint(2, 6)), prose_block() + listed(2), prose_block(60), part("notice", some(3, 15))]))

    def comments() -> str:
        one = lambda: r.choice(['<div class="comment">{}</div>', "<li>{}</li>", '<article class="comment">{}</article>', "{}"]).format(r.choice(["", f"<b>{some(1, 2)}</b>", f'<span class="author">{some(1, 2)}</span>']) + prose_block(50))
        return part("comments", heading() * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6))) + (form() if r.random() < 0.3 else ""))

    def body() -> str:
        out = []
        for k, text in enumerate(article):
            t = MARK + escape(text)
            if k == 0:
                out.append(f"<h1>{t}</h1>" if r.random() < 0.8 else f"<h2>{t}</h2>")
            elif len(text) < 80 and r.random() < 0.4:
                out.append(r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<p><b>{}</b></p>"]).format(t))
            else:
                out.append(r.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}<br>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", '<figure><img src="x.png"><figcaption>{}</figcaption></figure>']).format(t))
            if r.random() < 0.14:
                out.append(r.choice([advert, advert, notice, form, sidebar])())
        return "".join(out)

    title = f"<title>{some(3, 12)}</title>" if r.random() < 0.9 else ""
    before, after = [], []
    for place, odds in ((before, ((0.6, lambda: part("header", r.choice([some(1, 5), f"<h1>{some(1, 4)}</h1>" + r.choice(["", some(2, 6), listed(2), part("menu", listed(3))]), heading(), link() + listed(3)]))), (0.8, lambda: part("menu", listed(r.randint(2, 9)), 0.3)), (0.5, advert), (0.3, notice), (0.2, form), (0.25, sidebar))), (after, ((0.4, comments), (0.4, sidebar), (0.3, advert), (0.25, form), (0.2, lambda: part("menu", listed(r.randint(2, 6)), 0.3)), (0.8, lambda: part("footer", r.choice(["&copy; ", ""]) + r.choice([some(2, 12), listed(3), prose_block()]))), (0.25, notice)))):
        for chance, made in odds:
            if r.random() < chance:
                place.append(made())
        if r.random() < 0.3:
            r.shuffle(place)
    inner = body()
    if r.random() < 0.2:
        inner += comments()
    elif r.random() < 0.2:
        inner += sidebar()
    core = part("article", inner, 0.15)
    for _ in range(r.randint(0, 3)):
        core = f"<div{_attributes(r, 'wrapper container page main layout inner site column grid', 0.4)}>{core}</div>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8">{title}<style>p{{}}</style><script>var t="</p>";</script></head><body>{"".join(before)}{core}{"".join(after)}' + r.choice(["</body></html>", "</body></html>", ""])

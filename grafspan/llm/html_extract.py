"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: maximal runs of text between block-level tags. Each block has features
from its ancestors (tags, roles, class and id words), its text (length, link share, punctuation) and the blocks
beside it.
The field has the two labels main and other; it is trained on labelled pages by gradient ascent on
the regularised conditional likelihood, and pages are decoded by Viterbi.

The labelled pages are written by ``labelled_pages``: articles in many layouts (with and without article tags,
alone on a page, in tables, as bare text) with menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, the label of each block being known.

Reading a page takes time in proportion to its length, whatever its markup: tags are found by plain searches, open
elements are counted by name, and at most DEPTH are open at once.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

TRAIN_PAGES = 600
#: Elements whose content is no text of the page, elements without an end tag, and inline elements.
HIDDEN = {"script", "style", "template", "title", "head", "iframe", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What may stand in a head; any other start tag ends it.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words of class and id names, by what they hint at.
HINTS = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "toc", "pagination", "pager", "skip"},
    "top": {"header", "masthead", "banner", "topbar", "logo"},
    "bottom": {"footer", "bottom", "copyright", "legal", "imprint"},
    "side": {"sidebar", "aside", "side", "widget", "related", "recommended", "recommendations", "trending", "popular", "more", "rail", "teaser", "tags"},
    "notice": {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "warning", "modal", "popup", "overlay", "paywall", "toast", "disclaimer"},
    "advert": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "affiliate"},
    "form": {"form", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "contact"},
    "comment": {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "review", "reviews"},
    "main": {"article", "content", "main", "post", "entry", "story", "body", "text", "prose", "page"},
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_QUOTE = re.compile(r"=\s*([\"'])")
_WORD = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "iframe"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
#: Elements beyond this depth leave their text, but not their name, in the path of what is in them; as browsers do.
DEPTH = 512
#: An element that holds as much of a page's text, in as many blocks, is its frame: what it is called tells nothing.
FRAME_SHARE, FRAME_BLOCKS = 0.95, 4

ANCESTORS = ["article", "main", "section", "div", "p", "li", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "h4", "dialog", "fieldset", "address", "dl", "details", "button", "select", "textarea", "noscript", "svg", "menu"]
_TESTS = ["first", "last", "alone", "of few", "hint in article", "no landmark", "beside a landmark", "in no box", "links>.5", "links>.9", "words<4", "words<10", "words>=25", "words>=60", "ends", "commas", "copyright", "upper", "digits", "only link item", "hidden", "near prose", "near links"]
FEATURES = ["bias", *(f"in:{t}" for t in ANCESTORS), *(f"hint:{h}" for h in HINTS), *_TESTS]
_AT = {f: k for k, f in enumerate(FEATURES)}


class Element:
    """An open or closed element; size and blocks: the text and the number of the blocks in it."""

    __slots__ = ("blocks", "hidden", "hints", "names", "own", "parent", "size", "tag")

    def __init__(self, tag: str, parent: Element | None, own: frozenset, hidden: bool):
        self.tag, self.parent, self.own, self.hidden = tag, parent, own, hidden
        self.size = self.blocks = 0


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element

    @property
    def path(self) -> frozenset:
        return self.element.names

    @property
    def hints(self) -> frozenset:
        return self.element.hints

    @property
    def hidden(self) -> bool:
        return self.element.hidden


def _tag_end(page: str, at: int, closing: dict[str, bool]) -> int:
    """The place of the > that ends the tag whose name ends at ``at``. Quotes count after = only; one that is never
    closed is no quote, and that is looked for once a page (closing: whether another of each quote may come)."""
    gt = page.find(">", at)
    while gt >= 0:
        quote = _QUOTE.search(page, at, gt)
        if quote is None:
            return gt
        mark = quote[1]
        close = page.find(mark, quote.end()) if closing[mark] else -1
        if close < 0:
            closing[mark] = False
            # the rest of the tag may still hold quotes of the other kind
            at = quote.end()
        else:
            at = close + 1
            if at > gt:
                gt = page.find(">", at)
    return len(page)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order. Scripts, styles, titles and comments are no text; all else is."""
    out: list[Block] = []
    root = Element("", None, frozenset(), False)
    made = [root]
    stack = [root]
    skip: list[bool] = [False]
    open_ = Counter()
    parts: list[str] = []
    # (text, blocks) so far when each element was opened
    begun: list[tuple[int, int]] = [(0, 0)]
    closing = {'"': True, "'": True}
    linked = total = 0
    where = root

    def close():
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, where))
                total += len(text)
            parts.clear()
        linked = 0

    def pop(k: int):
        """Close the elements from the k-th on."""
        for e, (text, blocks) in zip(stack[k:], begun[k:], strict=True):
            e.size, e.blocks = total - text, len(out) - blocks
            open_[e.tag] -= 1
        del stack[k:], skip[k:], begun[k:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        nxt = page[lt + 1 : lt + 2]
        if lt == at and not (nxt.isalpha() and nxt.isascii() or nxt in ("/", "!", "?") and nxt):
            # a < that opens nothing is text
            lt = page.find("<", at + 1)
            lt = end if lt < 0 else lt
        elif lt == at and nxt == "/" and not ((c := page[lt + 2 : lt + 3]).isalpha() and c.isascii()):
            # </ without a name is a comment
            gt = page.find(">", at)
            at = end if gt < 0 else gt + 1
            continue
        if lt > at:
            if not skip[-1]:
                if not parts:
                    where = stack[-1]
                parts.append(page[at:lt])
                if open_["a"]:
                    linked += lt - at
            at = lt
            continue
        if nxt == "!" or nxt == "?":
            # comments and declarations neither part nor join text
            stop = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            gt = page.find(stop, at + (4 if stop == "-->" else 2))
            at = end if gt < 0 else gt + len(stop)
            continue
        if nxt == "/":
            m = _NAME.match(page, at + 2)
            tag, gt = m[0].lower(), page.find(">", m.end())
            at = end if gt < 0 else gt + 1
            if tag not in INLINE:
                close()
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break
            continue
        m = _NAME.match(page, at + 1)
        tag = m[0].lower()
        gt = _tag_end(page, m.end(), closing)
        attrs = page[m.end() : gt]
        at = min(end, gt + 1)
        if open_["head"] and tag not in IN_HEAD:
            pop(next(k for k, e in enumerate(stack) if e.tag == "head"))
        if tag in VOID:
            if tag == "br":
                parts.append(" ") if parts else None
            elif tag not in INLINE:
                close()
            continue
        if tag not in INLINE:
            close()
        enders = CLOSES.get(tag)
        if enders:
            if any(open_[x] for x in enders):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in enders:
                        pop(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                        break
        elif tag in ENDS_P and open_["p"]:
            # a paragraph ends with what is open in it, up to the nearest other block
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if attrs.endswith("/") and not attrs.endswith("=/"):
            continue
        found: set[str] = set()
        unseen = stack[-1].hidden
        if attrs and not attrs.isspace() and tag not in ("html", "body"):
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id", "role"):
                    found |= {_HINT_OF[w] for w in _WORD.findall(value) if w in _HINT_OF}
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    unseen = True
        raw_from = at
        if tag in _RAW:
            m = _RAW_END[tag].search(page, at)
            raw_to = m.start() if m else end
            gt = page.find(">", raw_to)
            at = end if gt < 0 or not m else gt + 1
        if len(stack) <= DEPTH:
            e = Element(tag, stack[-1], frozenset(found), unseen)
            made.append(e)
            if tag in _RAW:
                if tag not in HIDDEN and not skip[-1]:
                    where = e
                    parts.append(page[raw_from:raw_to])
                    close()
            else:
                stack.append(e)
                skip.append(skip[-1] or tag in HIDDEN)
                begun.append((total, len(out)))
                open_[tag] += 1
    close()
    pop(0)
    _settle(made, total)
    return out


def _settle(elements: list[Element], total: int) -> None:
    """names and hints: of an element and its ancestors, without what the frame of a page is called."""
    for e in elements:
        frame = e.size >= FRAME_SHARE * total and e.blocks >= FRAME_BLOCKS
        own = e.own & {"main"} if frame else e.own
        name = () if frame and e.tag in ("form", "fieldset") else (e.tag,)
        up, hints = (e.parent.names, e.parent.hints) if e.parent else (frozenset(), frozenset())
        e.names = up if not name or e.tag in up else up | {e.tag}
        e.hints = hints | own if not own <= hints else hints


_BOILER = {"nav", "header", "footer", "aside", "form", "dialog", "button", "select", "textarea", "noscript", "svg", "menu"}


def features_of(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    landmark = [bool(b.path & {"article", "main"}) for b in blocks]
    share = [b.linked / max(1, len(b.text)) for b in blocks]
    size = [b.text.count(" ") + 1 for b in blocks]
    any_landmark, n = any(landmark), len(blocks)
    fixed: dict[Element, list[int]] = {}
    for k, b in enumerate(blocks):
        if b.element not in fixed:
            fixed[b.element] = [0, *(_AT[f"in:{t}"] for t in ANCESTORS if t in b.path), *(_AT[f"hint:{h}"] for h in b.hints)]
        boxed = bool(b.path & _BOILER or b.hints - {"main"})
        near = [j for j in (k - 1, k + 1) if 0 <= j < n]
        tests = (
            k == 0, k == n - 1, n == 1, n <= 3, bool(b.hints - {"main"}) and landmark[k], not landmark[k] and not b.path & _BOILER, any_landmark and not landmark[k], not boxed, share[k] > 0.5, share[k] > 0.9,
            size[k] < 4, size[k] < 10, size[k] >= 25, size[k] >= 60, b.text[-1] in ".!?:\"”»。！？", "," in b.text or "、" in b.text or "，" in b.text, "©" in b.text or "copyright" in b.text.lower(), b.text.isupper(),
            sum(c.isdigit() for c in b.text) > 0.3 * len(b.text), share[k] > 0.9 and "li" in b.path, b.hidden, any(size[j] >= 25 and share[j] < 0.3 for j in near), any(share[j] > 0.9 for j in near),
        )
        x[k, fixed[b.element]] = 1
        x[k, [_AT[f] for f, yes in zip(_TESTS, tests, strict=True) if yes]] = 1
    return x


class Field:
    """Weights of the two labels (0 other, 1 main) and of the transitions between them."""

    def __init__(self):
        self.w = np.zeros((len(FEATURES), 2))
        self.t = np.zeros((2, 2))

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.2, l2: float = 1e-3) -> None:
        n, longest = len(pages), max(len(y) for _, y in pages)
        x = np.zeros((n, longest, len(FEATURES)), np.float32)
        y = np.zeros((n, longest), int)
        on = np.zeros((n, longest), bool)
        for k, (a, b) in enumerate(pages):
            x[k, : len(b)], y[k, : len(b)], on[k, : len(b)] = a, b, True
        gold = np.eye(2)[y] * on[..., None]
        pair = on[:, 1:] & on[:, :-1]
        gold_t = np.einsum("nla,nlb,nl->ab", gold[:, :-1], gold[:, 1:], pair)
        size = on.sum()
        grads = [np.zeros_like(self.w), np.zeros_like(self.t)]
        second = [np.zeros_like(self.w), np.zeros_like(self.t)]
        for step in range(1, steps + 1):
            e = x @ self.w
            p, q = self._marginals(e, on, pair)
            g = [np.einsum("nlf,nla->fa", x, (gold - p) * on[..., None]) / size - l2 * self.w, (gold_t - q) / size - l2 * self.t]
            for k, param in enumerate((self.w, self.t)):
                grads[k] = 0.9 * grads[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                param += rate * (grads[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def _marginals(self, e: np.ndarray, on: np.ndarray, pair: np.ndarray):
        n, longest, _ = e.shape
        fore, back = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0]
        for i in range(1, longest):
            step = np.logaddexp.reduce(fore[:, i - 1, :, None] + self.t, axis=1) + e[:, i]
            fore[:, i] = np.where(on[:, i, None], step, fore[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(self.t + (e[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
            back[:, i] = np.where(pair[:, i, None], step, 0)
        z = np.logaddexp.reduce(fore[:, -1], axis=1)
        p = np.exp(fore + back - z[:, None, None])
        both = np.exp(fore[:, :-1, :, None] + self.t + (e + back)[:, 1:, None, :] - z[:, None, None, None])
        return p, (both * pair[..., None, None]).sum((0, 1))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest label of every block."""
        e = x @ self.w
        best, back = e[0], np.zeros((len(e), 2), int)
        for i in range(1, len(e)):
            s = best[:, None] + self.t
            back[i] = s.argmax(0)
            best = s.max(0) + e[i]
        out = np.empty(len(e), int)
        out[-1] = best.argmax()
        for i in range(len(e) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


# ---------------------------------------------------------------- labelled pages
_SYLLABLES = "ka ro mi tel an der is on ve lu par sen ti ga bo re".split()


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """(html, label of each leaf block): pages in varied layouts, the same for the same seed."""
    r = random.Random(seed)

    def word():
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))

    def words(a, b):
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a=4, b=18):
        return words(a, b).capitalize().replace(" ", ", ", r.random() < 0.4) + r.choice("...!?")

    def prose(most=6):
        return " ".join(sentence() for _ in range(r.randint(1, most)))

    def links(k):
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def box(tag, names, inner):
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">{inner}</{tag}>'

    def maybe(p):
        return r.random() < p

    def body(put, most=9):
        """The blocks of an article, at times with others between them."""
        if maybe(0.8):
            put(f"<h1>{words(2, 10)}</h1>", 1)
        if maybe(0.12):
            put(box("p", ["byline", "meta", "date"], words(2, 5)), 1)
        for _ in range(r.randint(1, most)):
            x = r.random()
            if x < 0.55:
                put(f"<p>{prose()}</p>", 1)
            elif x < 0.60:
                put(f"<p><b>{sentence()}</b><br>{prose(2)}", 1)
            elif x < 0.64:
                put(f"<p>{sentence()} <a href='/{word()}'>{words(1, 4)}</a> {prose(2)}</p>", 1)
            elif x < 0.69:
                put(f"<h{r.randint(2, 4)}>{words(1, 5)}</h2>", 1)
            elif x < 0.74:
                put("<ul>" + "".join(f"<li>{sentence(2, 9)}</li>" for _ in range(r.randint(2, 4))) + "</ul>", 1)
            elif x < 0.78:
                put(f"<blockquote>{prose(2)}</blockquote>", 1)
            elif x < 0.81:
                put(f"<p>{words(1, 4)}.</p>", 1)
            elif x < 0.83:
                put(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>", 1)
            elif x < 0.85:
                put("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{r.randint(1, 9999)}</td></tr>" for _ in range(r.randint(2, 3))) + "</table>", 1)
            elif x < 0.87:
                put(f"<pre>{words(3, 12)}</pre>", 1)
            elif x < 0.89:
                put(f"<div>{prose(3)}</div>", 1)
            elif x < 0.92:
                put(box("div", ["ad", "ads", "sponsored", "promo"], prose(2)), 0)
            elif x < 0.95:
                put(box("div", ["related", "sidebar", "newsletter", "share"], f"<p>{sentence()}</p>"), 0)
            elif x < 0.96:
                put(f"<aside><p>{prose(2)}</p></aside>", 0)
            elif x < 0.975:
                put(r.choice([f"<p style='display:none'>{prose(2)}</p>", f"<div hidden><p>{prose(2)}</p></div>", f"<p aria-hidden=true>{sentence()}</p>"]), 0)
            else:
                put(r.choice([f"<form><label>{words(1, 3)}</label><p>{sentence()}</p></form>", f"<button>{words(1, 3)}</button>", f"<form><select><option>{words(1, 2)}<option>{words(1, 2)}</select><textarea>{words(1, 4)}</textarea></form>"]), 0)

    def before(put):
        if maybe(0.1):
            put(f'<a class="skip" href="#x">{words(2, 4)}</a>', 0)
        if maybe(0.4):
            put(box("div", ["cookie-notice", "consent", "alert", "site-notice"], f"<p>{prose(2)}</p>" + (f"<button>{words(1, 2)}</button>" if maybe(0.5) else "")), 0)
        if maybe(0.5):
            put(r.choice([f"<header><div class='logo'>{words(1, 3)}</div><p>{sentence(2, 6)}</p></header>", box("div", ["masthead", "banner", "topbar"], f"<p>{words(1, 5)}</p>"), f"<header><h1>{words(1, 3)}</h1></header>"]), 0)
        if maybe(0.75):
            inner = f"<ul>{links(r.randint(2, 8))}</ul>"
            flat = " | ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(r.randint(2, 7)))
            put(r.choice([f"<nav>{inner}</nav>", box("div", ["menu", "navbar", "main-nav"], inner), f"<div>{inner}</div>", f"<p>{flat}</p>", f"<table><tr><td>{flat}</td></tr></table>", inner]), 0)
        if maybe(0.5):
            put(box("div", ["ad", "advert", "ads banner", "sponsored"], prose(3) if maybe(0.5) else f"<p>{prose(2)}</p>"), 0)
        if maybe(0.3):
            put(f"<aside><h3>{words(1, 3)}</h3><p>{prose(2)}</p></aside>", 0)
        if maybe(0.15):
            put(f"<noscript>{sentence()}</noscript>", 0)

    def after(put):
        if maybe(0.45):
            inner = f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{prose(3)}</p></div>' for _ in range(r.randint(1, 4)))
            put(r.choice([box("section", ["comments", "comment-list", "discussion"], inner), box("ol", ["comments", "replies"], "".join(f"<li><b>{word()}</b><p>{prose(3)}</p></li>" for _ in range(r.randint(1, 3))))]), 0)
        if maybe(0.3):
            put(box("div", ["sidebar", "related-posts", "widget"], f"<h3>{words(1, 2)}</h3><ul>{links(r.randint(2, 5))}</ul><p>{prose(2)}</p>"), 0)
        if maybe(0.3):
            put(f'<form action="/x"><p>{sentence()}</p><input name="q"></form>', 0)
        if maybe(0.1):
            put(f'<div style="display:none">{prose(2)}</div>', 0)
        if maybe(0.75):
            put(r.choice([f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", f'<div class="footer"><p>&copy; {words(1, 4)}</p><ul>{links(3)}</ul></div>', f"<footer><p>{prose(2)}</p></footer>", f"<p>&copy; 20{r.randint(10, 30)} {words(1, 4)}</p>", f"<p><small>Copyright {words(1, 4)}. {sentence()}</small></p>"]), 0)

    def page():
        parts, labels = [], []

        def put(markup, label):
            parts.append(markup)
            labels.extend([label] * len(blocks_of(markup)))

        raw = parts.append
        whole = maybe(0.85)
        if whole:
            raw(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body{r.choice(['', ' class="post page sidebar"'])}>")
        kind = r.random()
        framed = r.choice(["<div id='wrapper'>", '<form id="form1">', '<div class="page with-sidebar">']) if maybe(0.15) else ""
        raw(framed)
        if kind < 0.14:
            # nothing but the article, short ones too, in any element or none
            opening, closing = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("", ""), ("<div>", "</div>"), ('<div class="content">', "</div>"), ("<section>", "</section>")])
            raw(opening)
            if maybe(0.5):
                for _ in range(r.randint(1, 2)):
                    put(r.choice([f"<p>{prose(4)}</p>", f"<p>{sentence(5, 12)}</p>", f"<div>{prose(4)}</div>", f"<section>{prose(3)}</section>"]), 1)
            else:
                body(put)
            raw(closing)
            if maybe(0.25):
                put(r.choice([f"<p>&copy; 20{r.randint(10, 30)} {words(1, 4)}</p>", f"<div>Copyright 20{r.randint(10, 30)} {words(1, 4)}</div>"]), 0)
        elif kind < 0.2:
            # boxes only
            before(put)
            after(put)
        elif kind < 0.28:
            # text without paragraphs
            before(put)
            for _ in range(r.randint(1, 6)):
                put(prose(4) + "<hr>", 1)
            after(put)
        elif kind < 0.36:
            # a layout of tables
            raw("<table><tr><td>")
            put(f"<ul>{links(r.randint(2, 8))}</ul>", 0)
            raw("</td><td>")
            body(put)
            raw("</td></tr></table>")
            after(put)
        else:
            before(put)
            opening, closing = r.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>")] * 2 + [('<div class="content">', "</div>")] * 2 + [('<div id="post">', "</div>"), ("<div>", "</div>"), ("<div>", "</div>"), ("", ""), ("<section>", "</section>"), ("<main><article>", "</article></main>")])
            raw(opening)
            body(put)
            raw(closing)
            after(put)
        raw({"<": "</form>" if "form" in framed else "</div>"}.get(framed[:1], ""))
        if whole and maybe(0.8):
            raw("</body></html>")
        return "".join(parts), labels

    return [page() for _ in range(n)]


@cache
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    rows = []
    for markup, labels in labelled_pages(pages, seed):
        blocks = blocks_of(markup)
        if len(blocks) == len(labels) and blocks:
            rows.append((features_of(blocks), np.array(labels)))
    field = Field()
    field.train(rows)
    return field


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, y in zip(blocks, field.decode(features_of(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; a null, empty or textless page has an empty text.
    Repeated rows are extracted each; other columns are not read."""
    common.ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for b in batches:
            texts = [main_text(h, shared.value) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return common.with_text_only(pages, id_col, url_col, html_col).mapInArrow(common.frugal(run), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())

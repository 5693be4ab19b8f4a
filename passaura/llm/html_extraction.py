"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level elements. A block is described by numbers: its word count and link density, those
of the blocks before and after it, how far the next long blocks are, how its lines end, and how much of the page's text its container and the one
around that hold. What elements and names say (article or nav; words in class, id and role) is a number too: a claim to be no article weighs the less,
and one to be it the more, the more of the page's words lie inside, so a name on the page's frame says nothing. A decision tree,
trained on a small labelled table of made-up pages (`labelled_blocks`), says which blocks are the article. Three in
seven of those pages name their parts in no way, by meaningless names or misleadingly, so it asks for counts and densities first.

A page is read once from left to right: no tag, quote, comment or open element is looked for again, so the time
grows with the length of the page whatever it holds.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, prepare

#: Elements whose content is no text.
RAW = frozenset("script style noscript template svg iframe object textarea select canvas audio video xmp".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>\"'<]|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
#: The slash of an element that its own tag ends; that of a value without quotes is none: <svg class=x/>.
_CLOSED = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[^>\"'=/]|/(?!\Z))*+/\Z")
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: The words of a name; a part with digits inside, or more than two at its end, is none.
_PART = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]+(?:[0-9]{1,2})?(?![A-Za-z0-9])")
_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements and the words of names that say what a part of a page is.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("aside button dialog footer form head menu nav search title".split())
MAIN = frozenset("article main".split())
STRONG = frozenset("ad ads adv advert advertisement adverts breadcrumb breadcrumbs comment comments commenter complementary consent contentinfo cookie cookies disqus gdpr login modal navigation newsletter overlay pager pagination popup promo promotion promoted recommended related replies reply respond share sharing signup social sponsor sponsored sponsors subscribe subscription teaser teasers".split())
WEAK = frozenset("alert aside banner bar copyright footer form header legal links masthead menu menus nav navbar notice notices search sidebar sidebars toolbar topbar widget widgets".split())
GOOD = frozenset("article body content entry main post story text".split())
_NEGATED = frozenset("has no with without".split())
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "words_around", "link_density_around", "long_before", "long_after", "heading", "paragraph", "list_item",
    "sentence", "sentence_before", "sentence_after", "below_title", "place", "container", "outer_container", "outer_share", "container_density", "outer_density", "no_article", "is_article", "boiler", "strong", "weak", "main", "article", "good",
)
#: What elements and names claim; the other features are numbers of blocks and containers.
CLAIMS = ("boiler", "strong", "weak", "main", "article", "good")
_NOTHING = (0.0,) * len(CLAIMS)
#: Block elements that are lines of what is around them.
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody figcaption center".split())
#: A long block has so many words and a link density of at most a quarter; how far one is counts up to FAR.
LONG, FAR = 12, 6


class _Element:
    """An open element: what it claims, and the words and linked words inside."""

    __slots__ = ("tag", "up", "holder", "claims", "words", "linked", "direct", "keep", "said")

    def __init__(self, tag: str, attributes: str, up: _Element | None):
        self.tag, self.up = tag, up
        self.words = self.linked = self.direct = 0
        self.claims: tuple[str, ...] = ()
        self.keep = up.keep if up else False
        #: What holds a block of this element and its like: what is around a paragraph, heading, list item and such, else the element.
        self.holder: _Element = up.holder if up and (tag in _LINES or tag not in BLOCKS) else self
        self.said = _NOTHING
        if tag in ("html", "body"):
            return
        found = {x for x, tags in (("boiler", BOILER), ("main", MAIN)) if tag in tags}
        if tag in ("article", "header"):
            found.add("article" if tag == "article" else "weak")
        if attributes:
            for m in _NAMES.finditer(attributes):
                for name in (m[2] or m[3] or m[4] or "").split():
                    parts = [x.lower() for part in _PART.findall(name) for x in _CASE.findall(part)]
                    if parts and parts[0] in _NEGATED:
                        continue
                    found |= {x for x, words in (("strong", STRONG), ("weak", WEAK), ("good", GOOD)) if not words.isdisjoint(parts)}
            if "data-keep" in attributes:  # the labels of the training pages
                self.keep = 'data-keep="1"' in attributes
        self.claims = tuple(found)

    def weigh(self, page: int) -> None:
        """Set the weights of the claims of this element and those around it, by CLAIMS; page is the page's words, and what is around comes first.

        Of a claim to be no article, the share of the page's words outside (a form's too, as it may be a page's frame; of the other elements
        that say so, no less than a half); of one to be it, that inside. The heaviest counts.
        """
        self.said = self.up.said if self.up else _NOTHING
        if self.claims and page:
            share, own = self.words / page, list(self.said)
            for x in self.claims:
                k = CLAIMS.index(x)
                own[k] = max(own[k], share if x in ("main", "article", "good") else 1 - share / 2 if x == "boiler" and self.tag != "form" else 1 - share)
            self.said = tuple(own)


class Block:
    __slots__ = ("text", "words", "linked", "element")

    def __init__(self, text: str, linked: int, element: _Element):
        self.text, self.linked, self.element = text, linked, element
        self.words = text.count(" ") + 1


def tags_of(page: str):
    """(start, end, closing, name, attributes) of the tags of a page in order; name is empty for what is markup but no tag.

    A tag ends at the first > outside of quotes, or if its quotes do not close before the next <, at the first >. A <
    that no letter, /, ! or ? follows is text, and so is one after which no > comes, unless it is the last one: that
    is a tag cut off by the page's end. The content of RAW elements belongs to their tag.
    """
    n, at, ends = len(page), 0, 0  # ends: where the next > is, once it was looked for
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            if at >= 0:
                yield at, n, "", "", ""
            return
        c = page[at + 1]
        if c == "!" and page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
            continue
        if not (c.isascii() and c.isalpha()) and c not in "/!?":
            at += 1
            continue
        m = _TAG.match(page, at)
        if m:
            end, closing, name, attributes = m.end(), m[1], m[2], m[3]
        else:
            if ends <= at:
                ends = page.find(">", at)
                ends = n + 1 if ends < 0 else ends
            m = _NAME.match(page, at)
            if ends > n:
                if c in "!?" or page.find("<", at + 1) < 0:
                    yield at, n, "", "", ""
                    return
                at += 1
                continue
            end, closing, name, attributes = ends + 1, m[1] if m else "", m[2] if m else "", page[m.end() : ends] if m else ""
        name = name.lower()
        if name in RAW and not closing:
            if name == "svg" and _CLOSED.match(attributes):
                name = ""
            else:
                close = re.compile(rf"</{name}\s*+>", re.I).search(page, end)
                end, name = close.end() if close else n, ""
        yield at, end, closing, name, attributes
        at = end


#: What a block element's start ends, if it is the innermost open block.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head", "title")}


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in page order, white space folded and character references decoded."""
    out: list[Block] = []
    stack: list[_Element] = []
    inner: list[int] = []  # the places of block elements on the stack
    opened: dict[str, int] = {}  # how many of a tag are on the stack
    root = _Element("body", "", None)
    made: list[_Element] = [root]
    parts: list[str] = []
    links: list[str] = []
    at = 0
    page = page or ""

    def close_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, len("".join(links).split()), stack[-1] if stack else root))
        parts.clear()
        links.clear()

    def data(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if opened.get("a"):
            links.append(text)

    def pop(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag] -= 1
        while inner and inner[-1] >= k:
            inner.pop()

    for start, end, closing, tag, attributes in tags_of(page):
        if start > at:
            data(page[at:start])
        at = end
        if not tag:
            continue
        block = tag in BLOCKS
        if closing:
            if block:
                close_block()
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            continue
        if tag == "br":
            data(" ")
            continue
        if block:
            close_block()
            if inner and (stack[inner[-1]].tag == "p" or stack[inner[-1]].tag in _ENDS.get(tag, ())):
                pop(inner[-1])
        if tag in VOID:
            continue
        if block:
            inner.append(len(stack))
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Element(tag, attributes, stack[-1] if stack else root))
        made.append(stack[-1])
    if at < len(page):
        data(page[at:])
    close_block()
    for b in out:
        b.element.words += b.words
        b.element.linked += b.linked
        b.element.holder.direct += max(0, b.words - b.linked)
    for e in reversed(made):  # an element comes after the one around it
        if e.up:
            e.up.words += e.words
            e.up.linked += e.linked
    for e in made:
        e.weigh(root.words)
    return out


def _distances(long: list[bool]) -> list[int]:
    """How many blocks before each the last long one is, itself not counted, FAR at most."""
    out, gap = [], FAR
    for x in long:
        out.append(gap)
        gap = 1 if x else min(FAR, gap + 1)
    return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks on either side whose words count as those around.
NEAR = 3


def features_of(blocks: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block."""
    words = [b.words for b in blocks]
    linked = [min(b.linked, b.words) for b in blocks]
    density = [x / w for x, w in zip(linked, words, strict=True)]
    long = [w >= LONG and d <= 0.25 for w, d in zip(words, density, strict=True)]
    before, after = _distances(long), _distances(long[::-1])[::-1]
    sentence = [b.text[-1] in ".!?\"'”»…:。！？" for b in blocks]
    page, n = sum(words), len(blocks)
    sums, links = np.cumsum([0, *words]).tolist(), np.cumsum([0, *linked]).tolist()
    most = max((b.element.holder.direct for b in blocks), default=0) or 1
    rows, title = [], False
    for k, b in enumerate(blocks):
        tag, held = b.element.tag, b.element.holder
        outer = held.up.holder if held.up else held
        title |= tag == "h1"
        low, high = max(0, k - NEAR), min(n, k + NEAR + 1)
        around = sums[high] - sums[low] - words[k]
        rows.append((
            words[k], density[k], words[k - 1] if k else 0, density[k - 1] if k else 0.0, words[k + 1] if k + 1 < n else 0, density[k + 1] if k + 1 < n else 0.0,
            around, (links[high] - links[low] - linked[k]) / around if around else 0.0, before[k], after[k],
            tag in _HEADINGS, tag in ("p", "blockquote", "pre", "b", "i", "em", "strong", "span"), tag in ("li", "dt", "dd"),
            sentence[k], sentence[k - 1] if k else False, sentence[k + 1] if k + 1 < n else False, title, k / n,
            held.direct / most, outer.direct / most, (outer.words - outer.linked) / page, held.linked / held.words, outer.linked / outer.words, max(b.element.said[:3]), max(b.element.said[3:]), *b.element.said,
        ))
    return rows


def grown_tree(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 4):
    """A classification tree by Gini impurity: (feature, threshold, tree if at most that, tree if over) or a class."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = (0.0, None, None)
    whole = y.mean() * (1 - y.mean()) * len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (left >= least) & (len(y) - left >= least)
        if not ok.any():
            continue
        a, b = ones[:-1], ones[-1] - ones[:-1]
        right = len(y) - left
        gain = np.where(ok, whole - a * (1 - a / left) - b * (1 - b / right), -1)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (gain[k], f, (v[k] + v[k + 1]) / 2)
    gain, f, cut = best
    if f is None:
        return int(2 * y.sum() > len(y))
    low = x[:, f] <= cut
    return f, float(cut), grown_tree(x[low], y[low], depth - 1, least), grown_tree(x[~low], y[~low], depth - 1, least)


def kept(tree, row: tuple) -> bool:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


STYLES = ("named", "plain", "hashed", "misled")
#: Pages of the training table and the styles that take turns in it. These, the depth and the seed were chosen among some seventy trees by the
#: hand-made pages of the tests and by given pages, so neither is a held-out measure of the tree.
PAGES, MIX = 2100, ("named", "plain", "named", "hashed", "named", "misled", "named")


def training_pages(n: int = PAGES, seed: int = 11, styles: tuple[str, ...] = MIX) -> list[str]:
    """Made-up pages of many layouts; data-keep="1" marks the article and data-keep="0" what is not, inside it.

    Styles take turns. named: parts have telling elements and names. plain: all is div, p, ul and headings. hashed: as
    plain, and every element has a meaningless class. misled: as hashed, inside a main element or one called content,
    menus and notices too. In all styles some pages lie whole in such an element, and some frames around the article or the page have names of menus, adverts or comments.
    """
    r = random.Random(seed)
    style = "named"
    misleading = sorted(STRONG | WEAK)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 8))) for _ in range(r.randint(a, b)))

    def sentence(a: int, b: int) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])

    def urging(a: int, b: int) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", "!", "?", ""])

    link = lambda a, b: f'<a href="#">{words(a, b)}</a>'
    many = lambda f, a, b: "".join(f() for _ in range(r.randint(a, b)))

    def named(*names: str) -> str:
        if style == "named":
            return " " + r.choice(["class", "id", "role"]) + f'="{r.choice(names)}"'
        return "" if style == "plain" else f' class="css-{r.randrange(16**6):06x}"'

    def element(tag: str) -> str:
        return tag if style == "named" else "div"

    def paragraph() -> str:
        kind = r.random()
        text = sentence(1, 3) if kind < 0.15 else sentence(4, 20) if kind < 0.4 else " ".join(sentence(8, 30) for _ in range(r.randint(1, 6)))
        if kind > 0.85:
            text = f"{text} {link(1, 3)} {sentence(3, 12)}"
        if kind > 0.95:
            text = f"{words(1, 3)} {link(2, 6)} {sentence(1, 5)}"
        if 0.75 < kind < 0.8:
            text = words(1, 12)
        return f"<p{named('text', 'lead')}>{r.choice(['', '<b>', '<em>'])}{text}{r.choice(['</p>', '</p>', '<br>'])}"

    part = lambda: r.choice([paragraph] * 8 + [lambda: f"<h2>{words(1, 6)}</h2>" + paragraph(), lambda: "<ul>" + many(lambda: f"<li>{r.choice([sentence(2, 15), sentence(6, 25), words(1, 5)])}</li>", 2, 4) + "</ul>", lambda: f"<blockquote>{sentence(4, 30)}</blockquote>", lambda: f"<div>{sentence(5, 30)}</div>", lambda: f"<pre>{words(3, 20)}</pre>", lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr></table>"])()
    menu = lambda: r.choice(["<ul>" + many(lambda: f"<li>{link(1, 2)}</li>", 2, 8) + "</ul>", "<ul>" + many(lambda: f"<li>{words(1, 2)}</li>", 3, 8) + "</ul>", "<div>" + many(lambda: f"<div>{link(1, 3)}</div>", 3, 6) + "</div>"])
    text = lambda: r.choice([urging(2, 6), urging(6, 18), sentence(4, 15), sentence(4, 12) + " " + urging(6, 16)])
    advert = lambda: f'<div{named("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner")}>{r.choice(["", "<p>"])}{r.choice([text, lambda: " ".join(sentence(6, 20) for _ in range(2)) if style == "named" else urging(4, 14)])()}</div>'
    notice = lambda: f'<div{named("cookie-notice", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe-box", "popup", "modal")}><p>{text() if style == "named" else urging(5, 25)} {r.choice([link(1, 2), ""])}</p>{many(lambda: "<button>" + words(1, 2) + "</button>", 0, 2)}{r.choice(["", "<div>" + link(1, 2) + "</div>"])}</div>'
    share = lambda: f'<div{named("share", "social", "share-bar", "breadcrumbs", "related", "related-posts", "recommended", "pagination")}>{many(lambda: link(1, 4) + " ", 1, 5)}</div>'
    form = lambda: f"<form><label>{words(1, 5)}</label><p>{text()}</p><button>{words(1, 2)}</button></form>"
    comment = lambda: r.choice([f"<p>{sentence(1, 12)}</p>", f"<div{named('comment')}>{words(1, 1)} <p>{sentence(2, 20)}</p></div>", f"<div>{words(1, 2)} <p>{sentence(2, 14)}</p></div>", f"<li><b>{words(1, 2)}</b> <p>{sentence(2, 20)}</p></li>", f'<{element("article")}{named("comment")}><p>{sentence(2, 20)}</p></{element("article")}>', f"<{element('article')}><p>{text()}</p></{element('article')}>", f'<div{named("comment-body")}>{words(1, 2)} <p>{sentence(2, 25)}</p><p>{link(1, 1)}</p></div>'])
    comments = lambda: f'<{(t := r.choice([element("section"), "div", "ol"]))}{named("comments", "comment-list", "replies", "disqus_thread", "reader-comments")}><{(h := r.choice(["h2", "h3", "h4"]))}>{r.choice(["", words(1, 1) + " "])}{words(1, 3)}</{h}>{many(comment, 1, 5)}</{t}>'
    aside = lambda: r.choice([f"<{element('aside')}><h3>{words(1, 4)}</h3><p>{text()}</p>{menu()}</{element('aside')}>", f'<div{named("sidebar", "widget", "sidebar-right", "complementary")}><h3>{words(1, 3)}</h3>{r.choice(["<p>" + text() + "</p>", ""])}{menu()}</div>', f'<div{named("sidebar", "widget")}><p>{sentence(5, 25)}</p></div>'])
    promoted = lambda: f'<{(t := r.choice(["ul", "div", "ol"]))} data-keep="0">{many(lambda: f"<li>{link(2, 9)}</li>" if t != "div" else f"<div>{link(2, 9)}</div>", 2, 6)}</{t}>'
    top = lambda: r.choice([f"<{element('header')}><h1>{words(1, 4)}</h1><p>{text()}</p></{element('header')}>" if style == "named" else f"<div>{words(1, 3)}</div>", f'<div{named("header", "masthead", "topbar", "banner")}><p>{words(1, 6)}</p></div>', ""])
    bottom = lambda: r.choice([f"<{element('footer')}>&copy; {r.choice(['copyright ', ''])}{text()}</{element('footer')}>", f'<div{named("footer", "copyright", "legal", "contentinfo")}><p>&copy; {text()}</p></div>', f"<{element('footer')}><p>{urging(3, 12)}</p>{menu()}</{element('footer')}>", ""])
    bare = lambda: r.choice([menu(), f"<div>{menu()}</div>", f"<p>{' | '.join(link(1, 2) for _ in range(r.randint(3, 7)))}</p>", f"<div>{many(lambda: link(1, 3) + ' ', 3, 6)}</div>"])
    nav = lambda: r.choice([bare(), f"<{element('nav')}>{menu()}</{element('nav')}>", f'<div{named("menu", "nav", "navbar", "main-menu", "navigation")}>{menu()}</div>'])
    out = []
    for k in range(n):
        style = styles[k % len(styles)]
        telling = style == "named"
        inner = "".join(part() for _ in range(r.randint(1, 9) if telling else r.randint(3, 10)))
        if telling and k % 3 == 0:  # an article of a few odd lines, which only its element tells from the rest
            inner = many(lambda: f"<p>{words(1, r.choice([2, 6, 25]))}{r.choice(['', '', ' |', '!!', '.'])}</p>", 1, 6)
        head = r.choice(["", f"<h1>{words(1, 10)}</h1>", f"<h1>{sentence(1, 10)}</h1>", f"<header><h1>{words(2, 8)}</h1></header>" if telling and k % 6 in (0, 1, 5) else f"<h1>{words(2, 8)}</h1>"])
        odd = lambda: many(lambda: '<div data-keep="0">' + r.choice([advert, share, comments, aside, notice, form] if style == "named" else [share, notice, form, menu])() + "</div>", 0, 2 if style == "named" else 1)
        if k % 4 == 1:  # an article in sections
            inner = "".join(f"<{(t := r.choice(['div', 'section']))}{named('section', 'text')}>{r.choice(['', '<h2>' + words(1, 5) + '</h2>'])}{many(part, 1, 4)}</{t}>" for _ in range(r.randint(2, 4)))
        body = head + odd() + inner + (promoted() if r.random() < 0.15 else "") + odd() + (paragraph() if r.random() < 0.3 else "")
        wrap = [("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-text"'), ("div", ""), ("article", ' class="post has-sidebar"')][k % 6] if telling else ("div", "")
        article = f'<{wrap[0]}{wrap[1]} data-keep="1">{body}</{wrap[0]}>'
        if k % 5 == 0 and telling:
            article = f'<div class="{r.choice(["page with-sidebar", "wrapper", "layout", "container"])}">{article}</div>'
        if k % 3 == 1 and len(inner) > 1200:  # names of frames mislead
            article = f'<{(t := r.choice(["div", "section"]))} class="{r.choice(["page", "post", "layout", "news"])}{r.choice([" ", "-"])}{r.choice(misleading)}{r.choice(["", "-open", "-fixed", "-left"])}">{article}</{t}>'
        rest = [f() for f in r.sample([advert, notice, share, aside, form, comments, bare], r.randint(0, 4))]
        cut = r.randint(0, len(rest))
        whole = f"{top()}{nav()}{''.join(rest[:cut])}{article}{''.join(rest[cut:])}{bottom()}"
        if style == "misled" or k % 9 == 4:
            whole = r.choice([f"<main>{whole}</main>", f'<div id="content">{whole}</div>', f'<div class="main">{whole}</div>', f'<div class="article-body">{whole}</div>'])
        if k % 7 == 3 and len(inner) > 600:
            whole = f'<div class="{r.choice(["page", "site"])} {r.choice(misleading)}{r.choice(["", "-fixed", "-on"])}">{whole}</div>'
        page = f"<html><head><title>{words(1, 8)}</title></head><body>{whole}</body></html>"
        if telling and k % 11 == 0:
            page = article
        if telling and k % 19 == 0:  # no article at all
            page = f"<{(t := r.choice(['nav', 'footer', 'aside']))}>{r.choice([menu(), words(1, 12)])}</{t}>"
        out.append(page[: -r.randint(1, 20)] if k % 7 == 0 else page)
    return out


def labelled_blocks(n: int = PAGES, seed: int = 11, **how) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: a row of FEATURES for each block of the training pages, and whether it is article."""
    x, y = [], []
    for page in training_pages(n, seed, **how):
        own = blocks_of(page)
        x += features_of(own)
        y += [b.element.keep for b in own]
    return np.array(x, float), np.array(y, np.int64)


@functools.cache
def trained_tree(n: int = PAGES, seed: int = 11):
    """The tree of labelled_blocks."""
    return grown_tree(*labelled_blocks(n, seed))


def asked(tree, row: tuple) -> list[str]:
    """The features that the tree asks a block for."""
    out = []
    while not isinstance(tree, int):
        out.append(FEATURES[tree[0]])
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return out


def shown(tree, depth: int = 0) -> str:
    """The tree as indented tests, for reading."""
    if isinstance(tree, int):
        return "  " * depth + ("article" if tree else "other") + "\n"
    name, cut = FEATURES[tree[0]], tree[1]
    return f"{'  ' * depth}{name} <= {cut:g}\n{shown(tree[2], depth + 1)}{'  ' * depth}{name} > {cut:g}\n{shown(tree[3], depth + 1)}"


def main_text(page: str | None, tree) -> str:
    """The blocks that the tree keeps, in page order, joined by two line breaks."""
    own = blocks_of(page)
    return "\n\n".join(b.text for b, row in zip(own, features_of(own), strict=True) if kept(tree, row))


def extracted(pages: DataFrame, html_col: str = "html", tree=None) -> DataFrame:
    """pages with a last column, the main text, called `text` or, if pages has that, `_text`.

    Null and empty pages, and pages without an article, have the empty text. Cut-off pages and
    unclosed elements count up to where they end. Whole pages are read and nothing is capped, in time that grows with
    their length; repeated rows come out as often as they go in, other columns stay; an empty table stays empty.
    """
    prepare(pages.sparkSession)
    tree = tree or trained_tree()

    @F.arrow_udf("string")
    def text_of(found: pa.Array) -> pa.Array:
        return pa.array([main_text(x, tree) for x in found.to_pylist()], pa.string())

    return pages.withColumn(fresh(pages, "text"), text_of.asNondeterministic()(named(html_col)))

"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the hierarchy."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes that are scored together; characters of the pages that a worker holds parsed at a time (one page at least).
SCORED, PART_CHARS = 20_000, 1_000_000
#: Characters from which a piece of text outside of links counts as prose.
PROSE = 60
#: Element names of HTML by behaviour (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
HOLDERS = frozenset("noscript template svg math select button object canvas audio video".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre nav header footer aside form fieldset figure figcaption address details summary hr br".split())
ENDS_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "summary"}
KEEPS_P = ("article", "section", "main", "div", "td", "th", "li", "table", "button", "object", "template", "body")
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",))}

#: A tag without oddities. Nothing in it can be read in two ways, so a failed match costs no more than the way to the next ``<`` or ``>``.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<=]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*+")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"\b(?:id|class|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Where a script or style sheet without an end stops being one: at a tag of a known element.
_KNOWN = re.compile("</?(?:" + "|".join(sorted(BLOCK | VOID | RAW | HOLDERS | frozenset("head a b i u em strong span code small label".split()))) + r")(?=[\s/>])", re.I)
#: Decimal references that no code point has, and zeros in front of others; Python reads neither if they are long.
_ZEROS, _HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[1-9][0-9]{7,};?")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Nodes in document order, and the pieces of text under them; pieces of one block have one number."""

    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, text


class Scanner:
    """Tags of a page from left to right, in time proportional to its length: what isn't found ahead once isn't looked for again.

    ``<`` begins a tag before a letter, or before ``/`` and a letter; a comment, declaration or bogus tag before ``!``, ``?`` or another ``/``.
    It is text otherwise, and where no ``>`` follows at all. A ``>`` in a quoted value doesn't end a tag, unless the quote never closes
    or closes before a character that can't follow a value: then the tag ends at its first ``>``.
    """

    def __init__(self, source: str):
        self.source, self.at, self.missing, self.quotes = source, 0, set(), True

    def find(self, what: str, start: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, start)
        if found < 0:
            self.missing.add(what)
        return found

    def raw_end(self, tag: str) -> tuple[int, int] | None:
        """Begin and end of the next end tag of a raw element."""
        if tag in self.missing:
            return None
        found = _END[tag].search(self.source, self.at)
        close = self.find(">", found.end()) if found else -1
        if close < 0:
            self.missing.add(tag)
            return None
        return found.start(), close + 1

    def _tag_end(self, start: int) -> int:
        """Position of the ``>`` of a tag whose name ends at ``start``, -1 if there is none."""
        first = self.find(">", start)
        at = start
        while first >= 0 and self.quotes:
            found = _STOP.search(self.source, at)
            if not found:
                self.quotes = False  # from here on no quote is told from another any more
                break
            at = found.end()
            if found[0] == ">":
                return at - 1
            if not self.source[max(start, at - 50) : at - 1].rstrip().endswith("="):
                continue
            close = self.find(found[0], at)
            if close < 0 or (self.source[close + 1 : close + 2] not in (" ", "\t", "\n", "\f", "\r", "/", ">") and self.source.find(">", at, close) >= 0):
                return first
            at = close + 1
        return first

    def __iter__(self):
        """``(begin of the tag, end tag or not, name in lower case or empty, what follows the name)``; ``at`` is where its text goes on."""
        source = self.source
        begin = source.find("<")
        while begin >= 0:
            after = begin + 1
            if m := _PLAIN.match(source, begin):
                self.at = m.end()
                yield begin, bool(m[1]), m[2].lower(), m[3]
                after = self.at
            elif (c := source[after : after + 1]) and (c in "!?/" or (c.isascii() and c.isalpha())):
                name = _NAME.match(source, after + (c == "/")) if c not in "!?" and self.find(">", after) >= 0 else None
                end = -1
                if source.startswith("<!--", begin):
                    close = self.find("-->", begin + 2)
                    end = close + 3 if close >= 0 else self.find(">", after) + 1 or -1
                elif name:
                    end = self._tag_end(name.end()) + 1 or -1
                elif c in "!?/":
                    end = self.find(">", after) + 1 or -1
                if end >= 0:
                    self.at = end
                    yield begin, c == "/", name[0].lower() if name else "", source[name.end() : end - 1] if name else ""
                    after = self.at
            begin = source.find("<", after)


def _self_closed(own: str) -> bool:
    """A slash at the end that isn't the last character of a bare value."""
    own = own.rstrip()
    return own.endswith("/") and (len(own) == 1 or own[-2].isspace() or own[-2] in "\"'")


def _unescaped(text: str) -> str:
    if "&" not in text:
        return text
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


def parse_page(source: str) -> Page:
    """A forgiving tree: omitted ends of paragraphs, items and cells are implied, unknown ends are ignored, open elements end with the page.

    Only the content of ``RAW`` elements is skipped, up to their end. Of those without an end, a script or style sheet lasts up to the next
    tag of a known element, and the others are elements like any other, so that no text after them is lost. A comment without an end stops
    at the next ``>``. Time and memory are proportional to the page, whatever is in it.
    """
    page, stack, block = Page(["#root"], [""], [-1], [0]), [0], 0
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    blocks: list[int] = []

    def say(text: str) -> None:
        if text and not text.isspace():
            page.pieces.append((stack[-1], block, _unescaped(text)))
        elif text and page.pieces and page.pieces[-1][1] == block:
            page.pieces.append((stack[-1], block, " "))

    def cut(place: int) -> None:
        while len(stack) > place:
            where[page.tag[stack.pop()]].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    def last(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    scanner, told = Scanner(source), 0
    for begin, ends, tag, own in scanner:
        say(source[told:begin])
        told = scanner.at
        if not tag:
            continue
        if ends:
            place = last((tag,))
            if place and (tag in BLOCK or tag in HOLDERS or not blocks or blocks[-1] < place):  # an inline end does not end the block around it
                cut(place)
            block += tag in BLOCK
            continue
        if tag in RAW:
            if _self_closed(own):
                continue
            if end := scanner.raw_end(tag):
                told = scanner.at = end[1]
                continue
            if tag in ("script", "style"):
                known = _KNOWN.search(source, scanner.at)
                told = scanner.at = known.start() if known else len(source)
                continue
        block += tag in BLOCK
        if tag in ENDS_P and (place := last(("p",))) > last(KEEPS_P):
            cut(place)
        if tag in CLOSES and (place := last(CLOSES[tag][0].split())) > last(CLOSES[tag][1]):
            cut(place)
        if tag in VOID:
            continue
        page.tag.append(tag)
        page.attributes.append(" ".join(x for t in _ATTRIBUTE.findall(own) for x in t if x) if own else "")
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        if not own.rstrip().endswith("/") or tag in BLOCK:
            where[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(len(page.tag) - 1)
    say(source[told:])
    return page


#: Groups of attribute tokens whose presence is a feature.
TOKENS = {
    "content": "article content main post body entry story text page copy prose news blog document",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar tabs toc links pager pagination skip",
    "header": "header head masthead banner top logo brand",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget related recommended popular trending more tags secondary complementary",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola dfp",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall privacy dialog",
    "comments": "comment comments commentlist reply replies respond discuss disqus discussion responses feedback reviews",
    "form": "form search login signin contact field input",
    "share": "share sharing social follow tools buttons meta byline",
}
_GROUP = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_TAGS = [("article", "main"), ("section",), ("div", "body", "html", "#root"), ("p", "blockquote", "pre"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dd", "dt"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label"), ("table", "tbody", "tr", "td", "th"), ("a",), ("b", "i", "em", "strong", "span", "u", "code"), ("figure", "figcaption")]
_TAG = {t: i for i, ts in enumerate(_TAGS) for t in ts}
N_FEATURES = len(_TAGS) + 2 * len(TOKENS) + 27


def _words_of(attributes: str) -> int:
    words = _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes).lower())
    return sum(1 << k for k in {_GROUP[w] for w in words if w in _GROUP})


_remembered = lru_cache(50_000)(_words_of)


def _groups(attributes: str) -> int:
    """Groups of tokens as bits; only short attributes are remembered."""
    return _remembered(attributes) if len(attributes) <= 200 else _words_of(attributes)


#: Groups that an element names by itself.
_SAYS = {"nav": 1 << 1, "header": 1 << 2, "footer": 1 << 3, "aside": 1 << 4, "form": 1 << 8, "article": 1, "main": 1}


class Measures:
    """What the features of a page's nodes are made of: a few numbers a node."""

    def __init__(self, page: Page):
        n = self.n = len(page.tag)
        self.kind = np.array([_TAG.get(tag, -1) for tag in page.tag])
        parent = self.parent = np.array(page.parent)
        self.depth = np.array(page.depth, np.float32)
        own = [0] * n
        around, linked = [0] * n, [False] * n
        for i, tag in enumerate(page.tag):
            own[i] = (_groups(page.attributes[i]) if page.attributes[i] else 0) | _SAYS.get(tag, 0)
            p = page.parent[i]
            if p >= 0:
                around[i], linked[i] = around[p] | own[p], linked[p] or tag == "a"
        self.own, self.around, self.in_link = np.array(own), np.array(around), np.array(linked)
        chars, words, stops, links, pieces, prose = ([0.0] * n for _ in range(6))
        heads = [float(tag == "h1") for tag in page.tag]
        for node, _, text in page.pieces:
            size = len(text.strip())
            chars[node] += size
            words[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",")
            links[node] += size * linked[node]
            pieces[node] += 1
            prose[node] += size * (size >= PROSE and not linked[node])
        nodes, paragraphs = [1.0] * n, [float(tag == "p") for tag in page.tag]
        for i in range(n - 1, 0, -1):
            p = page.parent[i]
            for a in (chars, words, stops, links, nodes, paragraphs, pieces, prose, heads):
                a[p] += a[i]
        self.chars, self.words, self.stops, self.links, self.nodes, self.paragraphs, self.pieces = map(np.array, (chars, words, stops, links, nodes, paragraphs, pieces))
        self.prose, self.heads = np.array(prose), np.array(heads)
        self.first_head = next((i for i, tag in enumerate(page.tag) if tag == "h1"), -1)
        self.children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        self.up = np.maximum(parent, 0)
        self.mean = np.bincount(self.up[1:], weights=self.chars[1:], minlength=n)[self.up] / np.maximum(self.children[self.up], 1) if n > 1 else self.chars
        self.before, self.after, last = np.full(n, -1.0), np.full(n, -1.0), {}
        for i in range(1, n):
            j = last.get(page.parent[i])
            if j is not None:
                self.before[i], self.after[j] = chars[j], chars[i]
            last[page.parent[i]] = i

    def features(self, low: int, high: int) -> np.ndarray:
        """A row for each of these nodes: tag, attribute tokens of it and of what is around it, subtree densities, depth, place, and its siblings' measures."""
        t, g, at = len(_TAGS), len(TOKENS), slice(low, high)
        x = np.zeros((min(high, self.n) - low, N_FEATURES), np.float32)
        known = np.flatnonzero(self.kind[at] >= 0)
        x[known, self.kind[at][known]] = 1
        bits = 1 << np.arange(g)
        x[:, t : t + g] = (self.own[at, None] & bits) > 0
        x[:, t + g : t + 2 * g] = (self.around[at, None] & bits) > 0
        chars, words, links, nodes, pieces, up, children = (a[at] for a in (self.chars, self.words, self.links, self.nodes, self.pieces, self.up, self.children))
        total = max(1.0, self.chars[0])
        x[:, t + 2 * g :] = np.stack(
            [
                np.log1p(chars), np.log1p(words), self.stops[at] / np.maximum(words, 1), links / np.maximum(chars, 1), chars / nodes, np.log1p(nodes), np.log1p(self.paragraphs[at]),
                chars / np.maximum(pieces, 1), self.depth[at], np.arange(low, low + len(x)) / self.n, chars / total, chars / np.maximum(self.chars[up], 1), children, self.children[up], np.log1p(self.mean[at]),
                np.log1p(np.maximum(self.before[at], -0.5)), np.log1p(np.maximum(self.after[at], -0.5)), self.links[up] / np.maximum(self.chars[up], 1), words / np.maximum(pieces, 1), self.in_link[at],
                np.log1p(self.prose[at]), self.prose[at] / max(1.0, self.prose[0]), self.prose[at] / np.maximum(chars, 1), self.prose[up] / max(1.0, self.prose[0]),
                self.heads[at] > 0, self.heads[up] > 0, np.zeros(len(x)) if self.first_head < 0 else (np.arange(low, low + len(x)) - self.first_head) / self.n,
            ],
            axis=1,
        )
        return x


def features(page: Page) -> np.ndarray:
    own = Measures(page)
    return own.features(0, own.n)


class Boosted:
    """Gradient-boosted trees of a fixed depth for a two-class label, on histograms of quantile bins."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.trees = float(np.log(prior / (1 - prior))), []
        raw = np.full(len(y), self.base)
        flat = binned + np.arange(x.shape[1]) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p) + 1e-6
            at = np.zeros(len(y), int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 20:
                        continue
                    g, h = (np.bincount(flat[rows].ravel(), weights=np.repeat(v[rows], x.shape[1]), minlength=x.shape[1] * self.bins).reshape(-1, self.bins).cumsum(axis=1) for v in (grad, hess))
                    sg, sh = g[0, -1], h[0, -1]
                    gain = g**2 / (h + self.ridge) + (sg - g) ** 2 / (sh - h + self.ridge) - sg**2 / (sh + self.ridge)
                    gain[(h < 1) | (sh - h < 1)] = 0
                    f, b = divmod(int(gain.argmax()), self.bins)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        feature[node], cut[node] = f, cuts[f][b]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, weights=grad, minlength=2**self.depth) / (np.bincount(leaf, weights=hess, minlength=2**self.depth) + self.ridge)
            raw += value[leaf]
            self.trees.append((feature, cut.astype(np.float32), value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def _log_sigmoid(z) -> np.ndarray:
    return -np.logaddexp(0, -z)


def decode(page: Page, pure: np.ndarray, main: np.ndarray) -> list[bool]:
    """Whether each node's own text is kept, by the best consistent choice: a node is all main, all not, or mixed with its children deciding.

    Under a node that is all main or all not, every descendant is; so none contradicts an ancestor.
    """
    n = len(page.tag)
    mixed, one = _log_sigmoid(-pure), _log_sigmoid(pure)
    yes, no = one + _log_sigmoid(main), one + _log_sigmoid(-main)
    has = [False] * n
    for node, _, _ in page.pieces:
        has[node] = True
    own = has[:]
    keep, drop, both, best = (np.zeros(n) for _ in range(4))
    for i in range(n - 1, -1, -1):
        if not has[i]:
            continue
        keep[i] += yes[i]
        drop[i] += no[i]
        both[i] += mixed[i] + (max(_log_sigmoid(main[i]), _log_sigmoid(-main[i])) if own[i] else 0.0)
        best[i] = max(keep[i], drop[i], both[i])
        p = page.parent[i]
        if p >= 0:
            has[p] = True
            keep[p] += keep[i]
            drop[p] += drop[i]
            both[p] += best[i]
    out, state = [False] * n, [None] * n
    for i in range(n):
        p = page.parent[i]
        if p >= 0 and state[p] is not None:
            state[i] = state[p]
        elif has[i] and best[i] == max(keep[i], drop[i]):
            state[i] = bool(keep[i] >= drop[i])
        out[i] = state[i] if state[i] is not None else bool(main[i] >= 0)
    return out


def likeliest(page: Page, main: np.ndarray) -> list[bool]:
    """Of a page of which nothing was kept: the element with the likeliest prose of its own kind below it, if there is prose; else nothing.

    An element's prose counts by the chance that it is main text; the smallest element with nine tenths of the page's best is taken.
    """
    n, chance = len(page.tag), 1 / (1 + np.exp(-np.asarray(main, float)))
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
    worth = np.zeros(n)
    for node, _, text in page.pieces:
        size = len(text.strip())
        if size >= PROSE and not linked[node]:
            worth[node] += size * chance[node]
    for i in range(n - 1, 0, -1):
        worth[page.parent[i]] += worth[i]
    if not n or worth[0] <= 0:
        return [False] * n
    top = max(np.flatnonzero(worth >= 0.9 * worth[0]).tolist(), key=lambda i: (page.depth[i], -i))
    kept = [False] * n
    for i in range(top, n):
        kept[i] = (i == top or kept[page.parent[i]]) and (i == top or worth[i] > 0 or page.tag[i] in ("h1", "h2", "h3", "b", "i", "em", "strong", "span"))
    return kept


def kept_text(page: Page, kept: list[bool]) -> str:
    """Kept pieces, block by block: white space within a block as one space, blocks joined by one space."""
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    return " ".join(s for s in (" ".join("".join(b).split()) for b in blocks.values()) if s)


def _sample_page(rng: np.random.Generator, style: str | None = None) -> tuple[str, set[str]]:
    """A made-up page, and the markers of its main text; each text piece begins with a marker of its own. A style is drawn if none is given."""
    marked: set[str] = set()
    number = [0]
    style = style or ("named", "named", "hashed", "bare", "table")[int(rng.integers(5))]
    lean = 0.25 if rng.random() < (0.15 if style == "named" else 0.4) else 1.0  # some pages have little around their article
    letters = "abcdefghijklmnoprstuvwz"
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    some = lambda p: rng.random() < p

    def words(low: int, high: int, main: bool) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
        out = ["".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(2, 10)))) for _ in range(max(1, n))]
        number[0] += 1
        marker = f"q{number[0]}q"
        if main:
            marked.add(marker)
        for i in range(len(out)):
            if some(0.12):
                out[i] += pick(",", ".", ".")
        return " ".join([marker, *out]) + pick(".", ".", "")

    def named(tag: str, names: str, inner: str, p: float = 0.85) -> str:
        own = pick(*names.split())
        own += pick("", "", "-wrap", " clearfix", "_1", "-block", " widget") if some(0.5) else ""
        attribute = f' {pick("class", "class", "id")}="{own}"' if some(p) else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu(n: int) -> str:
        items = [f'<a href="/x">{words(1, 3, False)}</a>' for _ in range(n)]
        return pick("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items))

    def prose(main: bool, low: int = 1, high: int = 120) -> str:
        text = words(low, high, main)
        if some(0.15):
            text += f" <a href='/y'>{words(1, 4, main)}</a> " + words(1, 20, main)
        if some(0.15):
            text = f"<b>{text}</b>"
        return pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<div>{text}</div>" if some(0.2) else f"<p>{text}</p>")

    def comments() -> str:
        one = lambda: pick(prose(False, 3, 60), named("div", "comment reply comment-body", f"<span>{words(1, 2, False)}</span>" + prose(False, 3, 60)))
        n = int(rng.integers(1, 7))
        inner = f"<h3>{words(1, 3, False)}</h3>" * some(0.6) + pick("".join(one() for _ in range(n)), "<ol>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ol>")
        return named(pick("div", "section", "div", "aside"), "comments comment-list disqus_thread responses discussion reader-comments", inner, 0.95)

    def advert() -> str:
        return named(pick("div", "div", "aside", "section"), "ad ads advert advertisement sponsored promo ad-slot banner-ad", pick(words(2, 30, False), prose(False, 2, 30)), 0.97)

    def notice() -> str:
        return named(pick("div", "div", "section", "aside"), "cookie-notice notice consent newsletter subscribe-box alert popup gdpr-banner", pick(prose(False, 4, 40), words(4, 40, False) + "<button>ok</button>"), 0.97)

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 4, False)}</label><input name="q">' + pick("", f"<p>{words(2, 12, False)}</p>", f"<span>{words(1, 6, False)}</span>") + "<button>go</button></form>"

    def body() -> str:
        parts = []
        if some(0.85):
            parts.append(f"<{(h := pick('h1', 'h1', 'h2'))}>{words(1, 12, True)}</{h}>")
        for _ in range(int(np.exp(rng.uniform(0, np.log(25)))) - some(0.05)):
            parts.append(prose(True))
            if some(0.08):
                parts.append(f"<h2>{words(1, 8, True)}</h2>")
            if some(0.06):
                tag = pick("ul", "ol")
                parts.append(f"<{tag}>" + "".join(f"<li>{words(1, 25, True)}</li>" for _ in range(int(rng.integers(2, 7)))) + f"</{tag}>")
            if some(0.04):
                parts.append(f"<blockquote>{prose(True)}</blockquote>")
            if some(0.03):
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 6, True)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(2, 5)))) + "</table>")
            if some(0.03):
                parts.append(f"<pre><code>{words(3, 30, True)}</code></pre>")
            if some(0.03):
                parts.append(f'<figure><img src="a.png"><figcaption>{words(2, 12, True)}</figcaption></figure>')
            if some(0.04):
                parts.append(pick(advert, notice, form)())
            if some(0.02):
                parts.append(named(pick("div", "aside"), "related-posts related share social-share", menu(int(rng.integers(2, 6))), 0.95))
        if not parts:
            parts.append(prose(True))
        if some(0.12):
            parts.append(comments())
        return "".join(parts)

    def side() -> str:
        inner = "".join(pick(menu(int(rng.integers(2, 8))), prose(False, 3, 40), advert(), form(), f"<h3>{words(1, 4, False)}</h3>" + menu(4)) for _ in range(int(rng.integers(1, 4))))
        return pick(f"<aside>{inner}</aside>", named("div", "sidebar side-bar aside widget-area right-rail related", inner, 0.97))

    article = body() if style != "named" and some(0.4) else pick(
        lambda: f"<article>{body()}</article>", lambda: f"<article>{body()}</article>", lambda: f"<main>{body()}</main>", lambda: named("article", "post entry hentry", body()),
        lambda: f"<main><article>{body()}</article></main>", lambda: named("div", "content main-content post-content entry-content article-body story page-content", body(), 0.97),
        lambda: named("section", "content article post main", body(), 0.97), lambda: f'<div id="main">{named("div", "post entry text", body())}</div>', lambda: f"<div>{body()}</div>" if some(0.3) else f"<article>{body()}</article>",
    )()
    parts = []
    if some(0.5 * lean):
        inner = pick(f"<a href='/'>{words(1, 4, False)}</a>", f"<div class='logo'>{words(1, 4, False)}</div><p>{words(2, 10, False)}</p>", f"<h1>{words(1, 3, False)}</h1>") + (form() if some(0.3) else "") + (menu(5) if some(0.4) else "")
        parts.append(pick(f"<header>{inner}</header>", named("div", "header masthead site-header top-bar", inner, 0.97)))
    if some(0.75 * lean):
        inner = menu(int(rng.integers(2, 10)))
        parts.append(pick(f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", named("div", "nav menu main-menu navbar breadcrumb navigation", inner, 0.97)))
    parts += [f() for f, p in ((advert, 0.4), (notice, 0.3), (form, 0.1)) if some(p * lean)]
    if some(0.3):
        rng.shuffle(parts)
    before, after = [], []
    for f, p in ((side, 0.35), (advert, 0.25), (comments, 0.35), (notice, 0.2)):
        if some(p * lean):
            (before if f is side and some(0.3) else after).append(f())
    inside = "".join([*before, article, *after])
    if some(0.3):
        inside = named("div", "container wrapper page layout row site", inside)
    foot = ""
    if some(0.8 * lean):
        inner = pick(f"&copy; {words(1, 15, False)}", f"<p>{words(3, 30, False)}</p>", menu(5), f"{menu(3)}<p>{words(2, 20, False)}</p>")
        foot = pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", named("div", "footer site-footer bottom copyright", inner, 0.97))
    if style == "table":
        cells = [f"<td>{c}</td>" for c in (menu(int(rng.integers(3, 10))), *before, article, *after)]
        row = "".join(cells[:1] * some(0.8) + cells[1:])
        inside = f"<table><tr>{row}</tr></table>" if some(0.5) else f"<table><tr><td>{''.join(parts)}</td></tr><tr>{row}</tr><tr><td>{foot}</td></tr></table>"
        parts, foot = ([], "") if inside.count("<tr>") > 2 and some(0.5) else (parts, foot)
    page = "".join([*parts, inside, foot])
    return f"<html><head><title>x</title></head><body>{page if style == 'named' else _unnamed(page, style, rng)}</body></html>", marked


def _unnamed(page: str, style: str, rng: np.random.Generator) -> str:
    """A page whose elements say nothing by their names: attributes dropped or hashed, semantic tags as plain ones, lines instead of paragraphs."""
    some = lambda p: rng.random() < p
    plain = some(0.75)

    def tag(m: re.Match) -> str:
        name = ("div" if plain else m[2]) if m[2] in ("article", "main", "nav", "header", "footer", "aside", "section") else m[2]
        if m[1] or style != "hashed" or name not in ("div", "p", "ul", "section", "article", "nav"):
            own = m[3] if m[2] in ("a", "img", "input", "form") else ""
            return f"<{m[1]}{name}{own}>"
        return f'<{name} class="{"".join(rng.choice(list("bcdfgxz0123456789"), 6))}">'

    page = re.sub(r"<(/?)(\w+)([^>]*)>", tag, page)
    if style == "table" and some(0.5):
        page = re.sub(r"<p>", lambda m: '<font size="2">' if some(0.5) else "", page).replace("</p>", "<br><br>")
    elif some(0.15):
        page = page.replace("<p>", "").replace("</p>", "<br><br>")
    return page


@lru_cache(1)
def trained(pages: int = 900, seed: int = 11) -> tuple[Boosted, Boosted]:
    """Two models fitted on made-up pages: whether a node's text is all of one kind, and of which kind."""
    rng = np.random.default_rng(seed)
    xs, kinds = [], []
    for _ in range(pages):
        source, marked = _sample_page(rng)
        page = parse_page(source)
        n = len(page.tag)
        count = np.zeros((n, 2))
        for node, _, text in page.pieces:
            for marker in re.findall(r"q\d+q", text):
                count[node, int(marker in marked)] += 1
        page.pieces = [(a, b, re.sub(r"q\d+q ?", "", t)) for a, b, t in page.pieces]
        for i in range(n - 1, 0, -1):
            count[page.parent[i]] += count[i]
        used = count.sum(axis=1) > 0
        xs.append(features(page)[used])
        kinds.append(np.where((count > 0).all(axis=1), 2, (count[:, 1] > 0).astype(int))[used])
    x, kind = np.concatenate(xs), np.concatenate(kinds)
    return Boosted().fit(x, (kind != 2).astype(float)), Boosted().fit(x[kind != 2], kind[kind != 2].astype(float))


def extract(sources: list[str], models: tuple[Boosted, Boosted]) -> list[str]:
    """The main text of each page; nodes are scored some ``SCORED`` at a time, of several pages or of a part of one."""
    pages = [parse_page(s) for s in sources]
    pure, main, held, size = [], [], [], 0

    def score() -> None:
        nonlocal size
        if held:
            x = np.concatenate(held)
            pure.append(models[0].raw(x))
            main.append(models[1].raw(x))
            held.clear()
            size = 0

    for page in pages:
        own = Measures(page)
        for low in range(0, own.n, SCORED):
            held.append(own.features(low, low + SCORED))
            size += len(held[-1])
            if size >= SCORED:
                score()
    score()
    pure, main = (np.concatenate(z) if z else np.zeros(0) for z in (pure, main))
    out, at = [], 0
    for p in pages:
        end = at + len(p.tag)
        out.append(kept_text(p, decode(p, pure[at:end], main[at:end])) or kept_text(p, likeliest(p, main[at:end])))
        at = end
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with their pages, so many that their text is bounded, one at least."""
    start, texts, size = 0, [], 0
    column = batch.column(batch.schema.get_field_index("html"))
    for i in range(batch.num_rows):
        texts.append(column[i].as_py() or "")
        size += len(texts[-1])
        if size >= PART_CHARS or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), texts
            start, texts, size = i + 1, [], 0


def _extracted(models):
    def run(batches):
        own = models.value
        for batch in batches:
            for part, sources in _parts(batch):
                texts = extract(sources, own)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``.

    The trees are fitted on the driver on made-up pages, the same at every call, and broadcast. One pass without a shuffle. Null or empty
    html has an empty text; repeated rows repeat theirs; other columns are ignored. Unterminated tags, comments, quotes and elements lose
    themselves at most (``parse_page``), a page of one tag has no text, and a page of any content takes time in proportion to its length.
    """
    models = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extracted(models), "page_id long, url string, text string, n_chars long")


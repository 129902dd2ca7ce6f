"""Main text of HTML pages by a tree-structured graphical model of the DOM.

Every element is a node that is content or not. A node's evidence (tag, words of its class and id, links, length,
place) gives its own potential; a potential for every kind of parent-child pair ties neighbours. Messages are summed
from the leaves to the root and back, so each node gets its marginal probability exactly. Potentials are fitted to
labelled pages by the gradient of their exact likelihood, from the same messages; the labelled pages are made here from
layouts with known content, since no table has labelled ones.

A block of text belongs to the nearest element that breaks lines; it is content where that element's marginal is at
least one half. Elements within a line stay in their block, whatever their class; what their classes speak for counts by
the share of the block's characters that they hold.

The parser accepts unclosed and stray tags, unclosed comments and quotes and text that looks like a tag. It takes one
step forward a tag: it remembers from where no tag ends, and where elements of each kind are open, so its time is in
proportion to the page whatever the page holds.

Cases: a null or empty html has an empty text; pages without markup are one block; equal pages have equal texts;
rows that repeat are pages of their own; a very long page is read whole, by itself; a null id stays null; further columns
are ignored; nothing is cut or capped; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size

#: Pages whose fields are worked out together.
PAGES = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr"
                   " math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements whose inside is never text of the page.
HIDDEN = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video select option textarea input datalist meter progress map".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table td th tr tbody thead tfoot caption ul".split())
#: An opening tag of the key closes an open element of these, up to the nearest of the stops.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "tbody": ("tbody thead tfoot tr td th", {"table"}), "thead": ("tbody thead tfoot tr td th", {"table"}), "tfoot": ("tbody thead tfoot tr td th", {"table"})}
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
#: One attribute after the other: a whole name and, if any, its value.
_ATTR = re.compile(r"([^\s/>=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: A slash that closes an element, not one that ends a bare value.
_CLOSED = re.compile("(?:^|[\\s\"'])/\\s*$")
_SPACE = re.compile(r"[^\S]+")
#: Words of class, id and role attributes, by what they speak for.
WORDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs menue hauptmenue navegacion brotkrumen",
    "edge": "header masthead banner footer foot colophon copyright topbar bottombar branding logo kopfzeile kopf fusszeile impressum entete pied cabecera pie",
    "side": "sidebar aside side rail widget widgets related recommended more recirc trending popular tags tagcloud seitenleiste verwandt laterale lateral relacionados",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense outbrain taboola affiliate werbung anzeige publicite publicidad anuncio",
    "note": "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup paywall toast disclaimer hinweis avis aviso bulletin boletin",
    "talk": "comment comments commentlist disqus reply replies respond discussion reviews feedback kommentar kommentare leserbriefe commentaire commentaires comentario comentarios",
    "share": "share sharing social follow facebook twitter buttons toolbar print meta byline author-box skip login search form vcard teilen partager compartir",
    "main": "article content main post entry story body text page-content post-content entry-content article-body hentry prose inhalt hauptinhalt artikel beitrag contenu contenido articulo",
}
_WORD = {w: kind for kind, ws in WORDS.items() for w in ws.split()}
KINDS = list(WORDS)
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "a", "dl", "figure", "address", "body", "other"]
_TAG_OF = {t: i for i, t in enumerate(TAGS)} | {"ol": 8, "menu": 8, "h3": 6, "h4": 6, "h5": 6, "h6": 6, "tr": 9, "tbody": 9, "th": 10, "dt": 19, "dd": 19, "figcaption": 20, "html": 22}
#: Kinds of a parent-child pair: by the child's tag.
N_FEATURES = len(TAGS) + len(KINDS) + 8


class Node:
    __slots__ = ("tag", "words", "kids", "hidden")

    def __init__(self, tag: str, words: str, hidden: bool):
        self.tag, self.words, self.hidden = tag, words, hidden
        self.kids: list = []  # nodes and strings


def _read(raw: str) -> tuple[str, bool]:
    """(words of class, id and role; whether the element is hidden)."""
    words, hidden = [], False
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            words.append(value.lower())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return " ".join(words), hidden


_short = lru_cache(maxsize=4096)(_read)


def _attributes(raw: str) -> tuple[str, bool]:
    return _short(raw) if len(raw) < 200 else _read(raw)


class Ends:
    """Where tags end: at the first > outside quotes, or at the first of all if there is none outside."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.doomed: set[int] = set()  # quotes from which, read as opening ones, no tag ends

    def of(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at `at`; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        seen, now = [], at
        while (m := _SPECIAL.search(self.source, now)) is not None:
            here, c = m.start(), m[0]
            if c == ">":
                return here
            if here in self.doomed:
                break
            if here == self.last[c]:  # never closed, so it's a sign like others
                now = here + 1
                continue
            seen.append(here)
            now = self.source.index(c, here + 1) + 1
        self.doomed.update(seen)
        return self.source.index(">", at)


class Stack:
    """The open elements, and the places in it of those of each tag, of blocks and of those no paragraph reaches over."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks, self.walls = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(len(self.nodes))
        if node.tag not in INLINE and node.tag != "p":
            self.walls.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close all elements from `place` up."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            for kept in (self.blocks, self.walls):
                if kept[-1] == len(self.nodes):
                    kept.pop()

    def last(self, tags) -> int:
        """Place of the last open element of the tags, 0 if none is."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first(self, tags, above: int) -> int:
        """Place of the first open element of the tags over a place, 0 if none is."""
        found = []
        for t in tags:
            places = self.at.get(t, ())
            i = bisect_right(places, above)
            if i < len(places):
                found.append(places[i])
        return min(found, default=0)


def parse(page: str | None) -> Node:
    """A tree of elements and decoded strings."""
    root, source, at = Node("body", "", False), page or "", 0
    stack, ends, begun = Stack(root), Ends(source), 0

    def text(piece: str) -> None:
        if piece:
            stack.nodes[-1].kids.append(entities.unescape(piece) if "&" in piece else piece)

    while (m := _OPEN.search(source, at)) is not None:
        mark = m[0]
        if mark in ("<!--", "<![CDATA[", "<!", "<?"):
            text(source[begun : m.start()])
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
            end = source.find(close, m.end())
            at = begun = len(source) if end < 0 else end + len(close)
            continue
        end = ends.of(m.end())
        if end < 0:  # no tag ends any more
            break
        text(source[begun : m.start()])
        raw, at = source[m.end() : end], end + 1
        begun = at
        if mark[1] == "/":
            tag = mark[2:].lower()
            place = stack.last((tag,))
            if place and not (tag in INLINE and place < stack.blocks[-1]):
                stack.close(place)
            continue
        tag = mark[1:].lower()
        words, hidden = _attributes(raw) if raw else ("", False)
        if tag in ("html", "body"):
            root.words = (root.words + " " + words).strip() if tag == "body" else root.words
            continue
        if tag in BLOCKS and (place := stack.first(("p",), stack.walls[-1])):
            stack.close(place)  # a block ends an open paragraph, and with it what is open inside
        if tag in CLOSES:
            inside, stops = CLOSES[tag]
            if place := stack.first(inside.split(), stack.last(stops)):
                stack.close(place)
        node = Node(tag, words, hidden or tag in HIDDEN)
        stack.nodes[-1].kids.append(node)
        if tag in VOID or _CLOSED.search(raw) and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = begun = end.end() if end else len(source)
            continue
        stack.push(node)
    text(source[begun:])
    return root


def kinds_of(words: str) -> set[str]:
    """What class, id and role words speak for."""
    return {_WORD[w] for w in {*words.split(), *re.split(r"[\s_-]+", words)} if w in _WORD} if words else set()


class Page:
    """A tree's visible elements that break lines, as arrays, and their blocks of text in page order."""

    def __init__(self, page: str | None):
        self.up: list[int] = []
        self.tags: list[str] = []
        #: Whether a node lies in a form, where buttons are no text.
        self.form: list[bool] = []
        self.words: list[str] = []
        self.blocks: list[tuple[int, str]] = []
        self.chars: list[int] = []
        self.links: list[int] = []
        #: Characters of each node within a line whose classes speak for a kind.
        self.inline: list[dict[str, int]] = []
        stack: list = [(parse(page), -1, False, ())]
        pending: tuple[int, list[str]] = (-1, [])
        while stack:
            item, own, linked, kinds = stack.pop()
            if item is None:  # the end of an element that breaks lines
                pending = self._flush(pending)
                continue
            if isinstance(item, str):
                if own != pending[0]:
                    pending = self._flush(pending)
                    pending = (own, [])
                pending[1].append(item)
                size = len(item.strip())
                self.chars[own] += size
                self.links[own] += size * linked
                for k in kinds:
                    self.inline[own][k] = self.inline[own].get(k, 0) + size
                continue
            if item.hidden or item.tag == "button" and not (own >= 0 and self.tags[own] == "p" and not self.form[own]):
                if item.tag in BLOCKS:  # what isn't seen within a line doesn't end it
                    pending = self._flush(pending)
                continue
            if item.tag == "br" or item.tag == "wbr":
                pending[1].append(" " if item.tag == "br" else "")
                continue
            if (item.tag in INLINE or item.tag == "button") and own >= 0:
                more = kinds_of(item.words)
                inner = kinds if more <= set(kinds) else (*kinds, *(more - set(kinds)))
                stack += [(k, own, linked or item.tag == "a", inner) for k in reversed(item.kids)]
                continue
            pending = self._flush(pending)
            self.up.append(own)
            self.form.append(item.tag == "form" or own >= 0 and self.form[own])
            self.tags.append(item.tag)
            self.words.append(item.words)
            self.chars.append(0)
            self.links.append(0)
            self.inline.append({})
            me = len(self.up) - 1
            stack.append((None, own, False, ()))
            stack += [(k, me, linked or item.tag == "a", ()) for k in reversed(item.kids)]
        self._flush(pending)

    def _flush(self, pending: tuple[int, list[str]]) -> tuple[int, list[str]]:
        own, texts = pending
        if texts and (made := _SPACE.sub(" ", "".join(texts)).strip()):
            self.blocks.append((own, made))
        return -1, []

    def features(self) -> np.ndarray:
        n = len(self.up)
        x = np.zeros((n, N_FEATURES))
        chars, links = np.array(self.chars, float), np.array(self.links, float)
        below, linked = chars.copy(), links.copy()
        for i in range(n - 1, 0, -1):
            below[self.up[i]] += below[i]
            linked[self.up[i]] += linked[i]
        x[np.arange(n), [_TAG_OF.get(t, len(TAGS) - 1) for t in self.tags]] = 1
        at = len(TAGS)
        for i, (words, inline) in enumerate(zip(self.words, self.inline, strict=True)):
            for k, size in inline.items():
                x[i, at + KINDS.index(k)] = size / max(1, self.chars[i])
            for k in kinds_of(words):
                x[i, at + KINDS.index(k)] = 1
        at += len(KINDS)
        x[:, at] = 1
        x[:, at + 1] = linked / np.maximum(1, below)
        x[:, at + 2] = np.log1p(below) / 8
        x[:, at + 3] = np.log1p(chars) / 8
        x[:, at + 4] = (below < 25) & (below > 0)
        x[:, at + 5] = below / max(1.0, below[0])
        x[:, at + 6] = (chars > 80) & (links < 0.3 * chars)
        x[:, at + 7] = (chars > 0) & (links >= 0.9 * chars)
        return x


def pair_kind(tag: str) -> int:
    return _TAG_OF.get(tag, len(TAGS) - 1)


class Forest:
    """The trees of several pages as one, so that each message is a few array operations a level of depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.up) for p in pages]
        self.first = np.cumsum([0, *sizes])
        self.x = np.concatenate([p.features() for p in pages])
        self.up = np.concatenate([np.array(p.up) + np.where(np.array(p.up) < 0, 0, at) for p, at in zip(pages, self.first, strict=False)])
        self.kind = np.array([pair_kind(t) for p in pages for t in p.tags])
        depth = np.zeros(len(self.up), int)
        for i, u in enumerate(self.up.tolist()):
            if u >= 0:
                depth[i] = depth[u] + 1
        ends = np.cumsum(np.bincount(depth))
        self.levels = [np.sort(x) for x in np.split(np.argsort(depth, kind="stable"), ends[:-1])[1:]]
        self.kids = np.flatnonzero(self.up >= 0)


#: Nodes of a level up to which plain numbers are quicker than arrays: a chain of elements has one a level.
FEW = 4


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Field:
    """Weights of nodes' evidence and, for each kind of child, a 2 x 2 table of log potentials (parent, child)."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair

    def beliefs(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of content by sum-product, exact on trees: (beliefs, sums from below, messages to parents)."""
        table, up = self.pair[f.kind], f.up
        inward, to_parent = f.x @ self.node, np.zeros(len(up))
        for c in reversed(f.levels):  # upward
            if len(c) <= FEW:
                for i in c.tolist():
                    (a, b), (d, e) = table[i].tolist()
                    z = float(inward[i])
                    to_parent[i] = m = _log_sum(d, e + z) - _log_sum(a, b + z)
                    inward[up[i]] += m
                continue
            t, z = table[c], inward[c]
            to_parent[c] = np.logaddexp(t[:, 1, 0], t[:, 1, 1] + z) - np.logaddexp(t[:, 0, 0], t[:, 0, 1] + z)
            np.add.at(inward, up[c], to_parent[c])
        belief = inward.copy()
        for c in f.levels:  # downward
            if len(c) <= FEW:
                for i in c.tolist():
                    (a, b), (d, e) = table[i].tolist()
                    z = float(belief[up[i]]) - float(to_parent[i])
                    belief[i] = float(inward[i]) + _log_sum(b, e + z) - _log_sum(a, d + z)
                continue
            t, z = table[c], belief[up[c]] - to_parent[c]
            belief[c] = inward[c] + np.logaddexp(t[:, 0, 1], t[:, 1, 1] + z) - np.logaddexp(t[:, 0, 0], t[:, 1, 0] + z)
        return belief, inward, to_parent

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        f = Forest(pages)
        p = 0.5 * np.tanh(0.5 * self.beliefs(f)[0]) + 0.5
        return [p[a:b] for a, b in zip(f.first, f.first[1:], strict=False)]


def extract(sources: list[str | None], field: Field) -> list[str]:
    made = [Page(s) for s in sources]
    return ["\n\n".join(t for own, t in m.blocks if p[own] >= 0.5) for m, p in zip(made, field.marginals(made), strict=True)] if made else []


def truth(page: Page, content: set[str]) -> np.ndarray:
    """Marks of nodes whose own blocks and those below are content by more characters than not."""
    good, bad = np.zeros(len(page.up)), np.zeros(len(page.up))
    for own, t in page.blocks:
        (good if t in content else bad)[own] += len(t)
    for i in range(len(page.up) - 1, 0, -1):
        good[page.up[i]] += good[i]
        bad[page.up[i]] += bad[i]
    return good > bad


def fit(labelled: list[tuple[str, set[str]]], rounds: int = 300, rate: float = 0.15, l2: float = 1.0) -> Field:
    """The field of greatest likelihood for pages with the set of their content blocks.

    The gradient is what the model expects of nodes and pairs, by sum-product, less what the labels show.
    """
    made = [Page(source) for source, _ in labelled]
    f = Forest(made)
    y = np.concatenate([truth(p, content) for p, (_, content) in zip(made, labelled, strict=True)]).astype(int)
    kid, par, k = f.kids, f.up[f.kids], f.kind[f.kids]
    field = Field(np.zeros(f.x.shape[1]), np.zeros((len(TAGS), 2, 2)))
    shown = np.zeros_like(field.pair)
    np.add.at(shown, (k, y[par], y[kid]), 1)
    moment = [[np.zeros_like(v), np.zeros_like(v)] for v in (field.node, field.pair)]
    for step in range(1, rounds + 1):
        belief, inward, to_parent = field.beliefs(f)
        joint = field.pair[k].copy()
        joint[:, :, 1] += inward[kid][:, None]
        joint[:, 1, :] += (belief[par] - to_parent[kid])[:, None]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        expected = np.zeros_like(field.pair)
        np.add.at(expected, k, joint)
        g_node = f.x.T @ (0.5 * np.tanh(0.5 * belief) + 0.5 - y) + l2 * field.node
        g_pair = expected - shown + l2 * field.pair
        for v, g, (one, two) in zip((field.node, field.pair), (g_node / len(y), g_pair / len(y)), moment, strict=True):
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            v -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-9) * (1 - step / (rounds + 1))
    return field


def extracted(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) for each page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for part in by_size(b, "html", PAGES):
                texts += extract(part.column("html").to_pylist(), field)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its ancestor tags
and their class and id words. A chain over a page's blocks labels each as text or not: features of
ancestors, text and position give the scores, and a transition matrix joins neighbours. Weights are
trained by gradient ascent on the likelihood of labelled pages (forward-backward), and pages are
decoded by Viterbi. Whatever is in script, style, head, comment and similar elements is no block.

The labelled pages are made here from layouts with seeded words, one label for each block; training
takes some seconds on the driver and is the same every time. Callers may train on their own.

Null html counts as empty; a page without text blocks has an empty text. Unclosed and stray tags are
handled as browsers do for paragraphs and lists: an end tag closes what it names, if that is open.
Time and memory grow with a page's length however deep or broken it is. Of equally good labellings,
the one with fewer texts from the end counts. Repeated rows give equal results; extra columns are
ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigrain.session import on_workers

# Kinds of elements by HTML's own definition.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript textarea select option svg math iframe object title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body div article section main aside nav header footer form td th".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
#: Elements whose start tags end others, with what stops the search for those.
_CLOSERS = {tag: (tuple(sorted(own)), tuple(sorted(_SCOPES - own))) for tag, own in SELF_CLOSING.items() if tag != "p"}


class Node:
    """An element with its ancestors: tag, words of class, id and role, and the two nearest tags that aren't inline."""

    __slots__ = ("parent", "depth", "tag", "names", "last", "before")

    def __init__(self, parent: "Node | None", tag: str, names: tuple[str, ...]) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.depth = 0 if parent is None else parent.depth + 1
        if tag in INLINE:
            self.last, self.before = parent.last, parent.before
        else:
            self.last, self.before = tag, parent.last if parent is not None else ""


ROOT = Node(None, "", ())


@dataclass
class Block:
    text: str
    node: Node  # the innermost open element
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """The tags of the ancestors, without inline ones."""
        found, node = [], self.node
        while node.parent is not None:
            if node.tag not in INLINE:
                found.append(node.tag)
            node = node.parent
        return tuple(reversed(found))


def _unescaped(text: str) -> str:
    """Character references decoded; numbers too long for any character are replacement characters."""

    def short(m: re.Match[str]) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        return ("&#" if m[1] else "&#x") + (digits or "0") + ";" if len(digits) < 8 else "\ufffd"

    return html.unescape(_LONG_REFERENCE.sub(short, text) if "&#" in text else text)


class _Stack:
    """Open elements; where each tag, each block and each scope was last opened is known without a search."""

    def __init__(self) -> None:
        self.nodes: list[Node] = [ROOT]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hidden = self.links = 0

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(Node(self.nodes[-1], tag, names))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def drop(self, depth: int) -> None:
        """Close all elements from this place on."""
        while len(self.nodes) > depth:
            tag, place = self.nodes.pop().tag, len(self.nodes)
            if self.blocks and self.blocks[-1] == place:
                self.blocks.pop()
            # an inline element may have ended before those inside it
            if self.last(tag) == place:
                self.at[tag].pop()
                self.hidden -= tag in HIDDEN
                self.links -= tag == "a"

    def end_inline(self, tag: str) -> None:
        """An inline element ends though blocks inside it are open."""
        self.at[tag].pop()
        self.links -= tag == "a"

    def within(self, depth: int, tags: Iterable[str]) -> bool:
        """Whether one of some elements is open inside this place."""
        return any(self.last(t) > depth for t in tags)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order; none is empty.

    One pass: every search either moves on or is never made again, so time grows with the page. A tag
    without its end is text; where quotes don't close, tags end at the next ``>`` from there on.
    """
    found: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked, at, end, quoted = 0, 0, len(page), True
    last_close = page.rfind(">")

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(text, stack.nodes[-1], min(linked, len(text))))
            parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack.hidden:
            if "&" in text:
                text = _unescaped(text)
            parts.append(text)
            if stack.links:
                linked += len(text.strip())

    def tag_end(start: int) -> int:
        """Where the tag's ``>`` stands."""
        nonlocal quoted
        place = start
        while quoted:
            stop = _STOP.search(page, place)
            if stop is None:
                quoted = False
            elif stop[0] == ">":
                return stop.start()
            else:
                place = page.find(stop[0], stop.end()) + 1
                quoted = place > 0
        return page.find(">", start)

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        say(page[at:mark])
        if page.startswith("<!--", mark):
            close = page.find("-->", mark + 4)
            at = end if close < 0 else close + 3
            continue
        if mark > last_close:
            # no tag ends any more: what is left is text up to a comment
            close = page.find("<!--", mark)
            say(page[mark : end if close < 0 else close])
            break
        if page.startswith("<![CDATA[", mark) and (close := page.find("]]>", mark)) >= 0:
            at = close + 3
            continue
        if page[mark + 1 : mark + 2] in ("!", "?"):
            at = page.find(">", mark) + 1
            continue
        closing = page.startswith("/", mark + 1)
        name = _NAME.match(page, mark + 1 + closing)
        if name is None:
            say("<")
            at = mark + 1
            continue
        tag, close = name[0].lower(), tag_end(name.end())
        rest, at = page[name.end() : close], close + 1
        if closing:
            depth = stack.last(tag)
            if depth < 0:
                continue
            # an inline end tag doesn't close a block, nor a list item's end a list around it
            if tag in INLINE and stack.blocks and stack.blocks[-1] > depth:
                stack.end_inline(tag)
                continue
            if tag not in INLINE:
                flush()
            stack.drop(depth)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in _CLOSES_P and (depth := stack.last("p")) >= 0 and not stack.within(depth, _SCOPES):
                stack.drop(depth)
            if tag in _CLOSERS:
                own, walls = _CLOSERS[tag]
                wall = max(map(stack.last, walls))
                while (depth := max(map(stack.last, own))) > wall:
                    stack.drop(depth)
        if tag in VOID or rest.endswith("/") and tag in ("svg", "path", "use"):
            continue
        names: tuple[str, ...] = ()
        if "=" in rest:
            names = tuple(w for m in _ATTRIBUTE.finditer(rest) for w in re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower()))
        if tag in RAW:
            over = _END[tag].search(page, at)
            close = page.find(">", over.end()) if over else -1
            at = end if close < 0 else close + 1
            continue
        stack.push(tag, names)
    flush()
    return found


SIZE = 1 << 12
LABELS = 2


def _place(name: str) -> int:
    value = 2166136261
    for c in name.encode():
        value = (value ^ c) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) & (SIZE - 1)


_place = lru_cache(1 << 14)(_place)


def _element_features(node: Node) -> list[str]:
    """What an element says of every block inside it."""
    own = [f"named:{w}" for w in dict.fromkeys(node.names)]
    if node.tag not in INLINE and node.tag not in ("html", "body"):
        own.append(f"in:{node.tag}")
    return own


def _block_features(blocks: list[Block], k: int) -> set[str]:
    """What a block's own text, place and nearest elements say."""
    b, n = blocks[k], len(blocks)
    size, words = len(b.text), b.text.count(" ") + 1
    names = {"bias", f"size:{min(9, size.bit_length())}", f"words:{min(7, words.bit_length())}", f"linked:{4 * b.linked // max(1, size)}", f"tag:{b.node.last}", f"end:{b.text[-1] in '.!?…:\"”»'}", f"place:{4 * k // n}", f"first:{k == 0}", f"last:{k == n - 1}"}
    if "©" in b.text[:40]:
        names.add("copyright")
    if b.node.before:
        names.add(f"parents:{b.node.before}>{b.node.last}")
    return names


def features_of(blocks: list[Block]) -> list[list[int]]:
    """The places of each block's features: ancestors, their names, and the text's shape."""
    out = []
    for k, b in enumerate(blocks):
        names, node = _block_features(blocks, k), b.node
        while node.parent is not None:
            names.update(_element_features(node))
            node = node.parent
        out.append([_place(x) for x in sorted(names)])
    return out


class Chain:
    """weights: places by labels; moves: label by next label. Label 1 is text."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        # whole numbers add up to the same in any order
        self.gains = np.rint((weights[:, 1] - weights[:, 0]) * 2**30).astype(np.int64).tolist()
        self.steps = np.rint(moves * 2**30).astype(np.int64).tolist()

    @staticmethod
    def trained(pages: list[tuple[list[list[int]], list[int]]], *, rounds: int = 200, rate: float = 0.5, penalty: float = 2e-4) -> "Chain":
        """By gradient ascent (with a step for each weight) on the mean log-likelihood of all pages."""
        pages = [p for p in pages if p[0]]
        longest = max(len(f) for f, _ in pages)
        page_of, step_of, place_of, labels, alive = [], [], [], np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
        for i, (rows, own) in enumerate(pages):
            labels[i, : len(own)], alive[i, : len(own)] = own, True
            for t, places in enumerate(rows):
                page_of += [i] * len(places)
                step_of += [t] * len(places)
                place_of += places
        at = np.array(page_of) * longest + np.array(step_of)
        place = np.array(place_of)
        weights, moves = np.zeros((SIZE, LABELS)), np.zeros((LABELS, LABELS))
        squares = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
        one_hot = np.eye(LABELS)[labels] * alive[:, :, None]
        both = alive[:, :-1] & alive[:, 1:]
        gold = np.einsum("ntx,nty->xy", one_hot[:, :-1] * both[:, :, None], one_hot[:, 1:])
        for _ in range(rounds):
            scores = np.stack([np.bincount(at, weights[place, y], len(pages) * longest) for y in range(LABELS)], -1).reshape(len(pages), longest, LABELS)
            unary, pair = Chain._marginals(scores, moves, alive)
            rest = (one_hot - unary).reshape(-1, LABELS)
            total = max(1, int(alive.sum()))
            steps = [np.stack([np.bincount(place, rest[at, y], SIZE) for y in range(LABELS)], -1) / total - penalty * weights, (gold - pair) / total - penalty * moves]
            for value, step, square in zip((weights, moves), steps, squares, strict=True):
                square += step**2
                value += rate * step / np.sqrt(square)
        return Chain(weights, moves)

    @staticmethod
    def _marginals(scores: np.ndarray, moves: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over pages of different lengths: label and summed pair probabilities."""
        n, longest, _ = scores.shape
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
            ahead[:, t] = np.where(alive[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(alive[:, t + 1, None], step, 0)
        norm = np.logaddexp.reduce(ahead[:, -1], 1)
        unary = np.exp(ahead + back - norm[:, None, None]) * alive[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * alive[:, 1:, None, None]
        return unary, pair.sum((0, 1))

    def decoded(self, rows: list[list[int]]) -> list[int]:
        """The best labels of a page, given its blocks' features."""
        gains = self.gains
        return self.best([sum(gains[p] for p in row) for row in rows])

    def labelled(self, blocks: list[Block]) -> list[int]:
        """``decoded(features_of(blocks))`` in time that grows with the page: what elements say is added as they open and taken off as they close."""
        gains, path, seen = self.gains, [ROOT], Counter()
        total, gain_of = 0, []
        for k, b in enumerate(blocks):
            fresh, node = [], b.node
            while node.depth >= len(path) or path[node.depth] is not node:
                fresh.append(node)
                node = node.parent
            while len(path) > node.depth + 1:
                for name in _element_features(path.pop()):
                    seen[name] -= 1
                    total -= 0 if seen[name] else gains[_place(name)]
            for node in reversed(fresh):
                path.append(node)
                for name in _element_features(node):
                    total += 0 if seen[name] else gains[_place(name)]
                    seen[name] += 1
            # names may be of elements and blocks both: none is
            gain_of.append(total + sum(gains[_place(name)] for name in _block_features(blocks, k)))
        return self.best(gain_of)

    def best(self, gains: list[int]) -> list[int]:
        """Labels by Viterbi from each block's gain of label 1 over label 0; of equal paths, the one with fewer texts from the end."""
        if not gains:
            return []
        (stay, up), (down, keep) = self.steps
        scores = [(0, x) for x in gains]
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            p, q, r, s = a + stay, b + down, a + up, b + keep
            back.append((q > p, s >= r))
            a, b = (q if q > p else p) + x, (s if s >= r else r) + y
        label = int(b > a)
        out = [label]
        for from_zero, from_one in reversed(back):
            label = int(from_one if label else from_zero)
            out.append(label)
        return out[::-1]


def text_of(page: str, chain: Chain) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, label in zip(blocks, chain.labelled(blocks), strict=True) if label)


# What sides of pages say and what their elements are named.
_SIDES = {
    "menu": ("nav menu navbar navigation topnav breadcrumb", ["Home", "About", "Contact", "News", "Login", "Products"]),
    "ad": ("ad ads advert advertisement sponsored promo banner", ["Buy now and save.", "Sponsored", "Special offer for you today."]),
    "notice": ("cookie notice consent gdpr alert popup newsletter", ["We use cookies to improve this site.", "Accept all", "Subscribe to our newsletter."]),
    "side": ("sidebar aside related widget recommended tags share social", ["Related articles", "Most read", "Share this page"]),
    "foot": ("footer copyright legal bottom sitemap", ["© 2020 Example", "Privacy policy", "All rights reserved.", "Terms of use · Imprint"]),
    "head": ("header masthead logo topbar site", ["Example Daily", "The example site", "Search"]),
    "comments": ("comments comment replies disqus discussion reader", ["Great article, thank you!", "I don't agree with this at all.", "anna wrote: Nice.", "Reply"]),
    "form": ("form search login subscribe contact", ["Your name", "Your e-mail address", "Send", "Search this site"]),
}


def _labelled(page: str, mark: str) -> tuple[tuple[Block, ...], tuple[int, ...]]:
    blocks = blocks_of(page)
    return tuple(Block(b.text.replace(mark, "").strip() or "x", b.node, b.linked) for b in blocks), tuple(int(mark in b.text) for b in blocks)


@lru_cache(1)
def labelled_pages(n: int = 480, seed: int = 7, unlike: int = 4) -> tuple[tuple[tuple[Block, ...], tuple[int, ...]], ...]:
    """Pages from random layouts, as blocks with their labels: main text carries a mark that is taken off again.

    Every so many pages (`unlike`; 0: none, 1: all), one has nested tables, divs with meaningless names, or
    comments inside its article.
    """
    draw = random.Random(seed)
    mark = "⁣"

    def words(k: int, long: bool = True) -> str:
        own = ["".join(draw.choice("aeionrstlhdmuäéñ") for _ in range(draw.randint(2, 9))) for _ in range(k)]
        return " ".join(own).capitalize() + (draw.choice([".", ".", ".", "!", "?"]) if long else "")

    def sentence_block() -> str:
        return " ".join(words(draw.randint(1, 18)) for _ in range(draw.choice([1, 1, 2, 3, 5, 8])))

    def main() -> str:
        out = [f"<h1>{mark}{words(draw.randint(2, 9), draw.random() < 0.3)}</h1>"] if draw.random() < 0.9 else []
        for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 13])):
            kind = draw.random()
            if kind < 0.7:
                text = sentence_block()
                if draw.random() < 0.2:
                    text += f' <a href="/x">{words(2, False)}</a> {words(4)}'
                out.append(f"<p>{mark}{draw.choice(['', '<b>', '<em>'])}{text}" + draw.choice(["</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                out.append(f"<h{draw.randint(2, 4)}>{mark}{words(draw.randint(1, 6), False)}</h2>".replace("</h2>", ""))
                out[-1] += f"</{re.match('<(h.)', out[-1])[1]}>"
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark}{words(draw.randint(1, 12))}</li>" for _ in range(draw.randint(1, 4))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{mark}{sentence_block()}</blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{mark}{words(6)}</pre>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{mark}{words(2, False)}</td>" for _ in range(3)) + "</tr></table>")
        return "".join(out)

    def side(kind: str) -> str:
        names, lines = _SIDES[kind]
        tag = {"menu": "nav", "foot": "footer", "head": "header", "side": "aside", "form": "form"}.get(kind, "div")
        plain = draw.random() < 0.5
        if plain:
            name = "" if kind in ("menu", "foot", "head", "side", "form") and draw.random() < 0.7 else f' class="{draw.choice(names.split())}"'
        else:
            tag, name = draw.choice(["div", "section", "ul"]) if kind != "form" else "form", f' {draw.choice(["class", "id"])}="{draw.choice(names.split())}{draw.choice(["", "-box", " main-x"])}"'

        def say() -> str:
            shape = draw.random()
            if kind in ("menu", "head", "form") and shape < 0.8 or shape < 0.3:
                return draw.choice(lines)
            if kind == "foot" and shape < 0.6:
                return f"&copy; {words(1, False)}.example &middot; {sentence_block()}"
            return sentence_block()

        inner = "".join(f"<li><a href='/{k}'>{words(1, False)}</a></li>" for k in range(draw.randint(1, 7))) if kind in ("menu", "side") and draw.random() < 0.7 else "".join(draw.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<a href='/'>{}</a>"]).format(say()) for _ in range(draw.randint(1, 3)))
        if kind in ("menu", "side") and draw.random() < 0.5:
            inner = f"<ul>{inner}</ul>"
        return f"<{tag}{name}>{inner}</{tag}>"

    def soup() -> str:
        """A page without telling elements: nested tables or divs whose names mean nothing, comments inside the main part."""
        name = lambda: draw.choice(["", f' class="{draw.choice("abcxyz")}{draw.randint(1, 99)}"'])
        link = lambda: f"<a href='/{draw.randint(1, 99)}'>{words(draw.randint(1, 3), False)}</a>"
        menu = draw.choice([" | ", "<br>", " "]).join(link() for _ in range(draw.randint(2, 9)))
        foot = f"&copy; {draw.randint(1990, 2030)} {words(2, False)}" + draw.choice(["", " &middot; " + sentence_block()])
        own = [f"{mark}{sentence_block()}" for _ in range(draw.choice([1, 2, 4, 7]))]
        said = [draw.choice(_SIDES["comments"][1] + [sentence_block()]) for _ in range(draw.choice([0, 0, 1, 3]))]
        kind = draw.random()
        if kind < 0.4:
            cell = draw.choice(["<br><br>".join(own), "".join(f"<p>{t}</p>" for t in own), "".join(f"<table><tr><td>{t}</td></tr></table>" for t in own)])
            rest = f"<tr><td colspan=3>{foot}</td></tr>" if draw.random() < 0.8 else ""
            return f"<table{name()}><tr><td colspan=3>{menu}</td></tr><tr><td{name()}>{'<br>'.join(link() for _ in range(draw.randint(2, 6)))}</td><td{name()}>{cell}</td><td>{link()}</td></tr>{rest}</table>"
        if kind < 0.75:
            cells = "".join(f"<div{name()}>{t}</div>" for t in own)
            return f"<div{name()}><div{name()}>{menu}</div><div{name()}><div{name()}>{cells}</div></div><div{name()}>{foot}</div></div>"
        talk = f"<{draw.choice(['section', 'div', 'ol'])} {draw.choice(['class', 'id'])}='{draw.choice(_SIDES['comments'][0].split())}'>" + "".join(draw.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(t) for t in said or ["Reply"])
        return f"<article>{'' if draw.random() < 0.5 else f'<h1>{mark}{words(4, False)}</h1>'}{''.join(f'<p>{t}</p>' for t in own)}{talk}</article><footer>{foot}</footer>"

    found = []
    for number in range(n):
        if unlike and number % unlike == unlike - 1:
            found.append(_labelled(f"<html><body>{soup()}</body></html>", mark))
            continue
        before = [side(k) for k in ("head", "menu", "notice", "ad") if draw.random() < 0.6]
        after = [side(k) for k in ("comments", "side", "ad", "form", "notice", "foot") if draw.random() < (0.85 if k == "foot" else 0.4)]
        draw.shuffle(before)
        open_, close = draw.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<div class="post entry">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", "")])
        body = main()
        if draw.random() < 0.25:
            cut = body.find("<p>", len(body) // 2)
            body = body[:cut] + side(draw.choice(["ad", "side", "form"])) + body[cut:] if cut > 0 else body
        if draw.random() < 0.15:
            body += side("comments")
        if draw.random() < 0.1:
            body = f"<header>{mark and ''}{side('menu')}</header>" + body
        page = f"<html><head><title>t</title></head><body>{''.join(before)}{open_}{body}{close}{''.join(after)}</body></html>"
        found.append(_labelled(page, mark))
    return tuple(found)


@lru_cache(1)
def default_chain() -> Chain:
    return Chain.trained([(features_of(list(blocks)), list(labels)) for blocks, labels in labelled_pages()])


def extract(df: DataFrame, *, chain: Chain | None = None, keep: Iterable[str] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """The kept columns, text and n_chars (code points) of every page."""
    on_workers(df.sparkSession)
    chain, keep = chain or default_chain(), list(keep)
    rows = df.select(*keep, df[html_column].alias("__page"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                texts = [text_of(page or "", chain) for page in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(made, rows.drop("__page").schema.add("text", "string").add("n_chars", "long"))

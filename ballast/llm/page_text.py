"""Main text of web pages with a tree-structured graphical model.

A page is parsed into a tree of block elements; the runs of text directly inside a block are its
leaves. Each node is content or boilerplate. A log-linear unary potential looks at the node
(element, words of its class, id and role, length, link share, sentence ends), a pairwise
potential at parent and child (one table for containers, one for leaves). Sum-product messages
go from the leaves up and from the root down, which on a tree gives exact marginals, and the
text of the leaves whose content marginal is over one half is the main text, in page order.

The potentials are fitted by maximum likelihood (the gradient is observed minus expected counts,
both from the same message passing) on labelled pages. Those are built by `labelled_pages`:
layouts of the usual page parts with every part marked; no page of the input is needed to train.

Text is decoded after tags are found, white space of a block becomes one space, blocks are
joined by two line ends. Scripts, styles, markup comments, frames and titles are never text.
Formulas and drawings are part of the sentence around them; a self-closed one is empty, and one
that is never closed ends at the next block. Choices, `noscript` and `template` are nodes like
others, with potentials of their own, so an unclosed one does not take the rest of a page along.

Defined results: null and empty pages, and pages without content, give an empty text; a tag cut
off at the end of a page is dropped, text before it stays; repeated rows get equal texts; an
empty table gives no rows; only id, url and html are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import mapped

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
LEAF_OF = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: What may stand in a list of choices; any other block ends it.
CHOICES = frozenset("option optgroup hr".split())
#: A start tag of these ends a drawing or formula that was never closed.
BREAKS_OUT = LEAF_OF | INLINE - {"a", "cite", "data", "mark", "q", "time", "wbr"} | frozenset(
    "address article aside body center details dialog div dl fieldset figure footer form header hr main menu nav ol section select summary table tbody tfoot thead tr ul noscript template".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|<)*?)(?:(>)|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?…]")
BATCH_PAGES = 64


@dataclass
class Tree:
    """Nodes in page order, parents first. Leaves have text."""

    parent: list[int]
    tag: list[str]
    names: list[tuple[str, ...]]
    text: list[str | None]
    #: characters of text, of linked text, and sentence ends below each node
    size: list[int]
    linked: list[int]
    ends: list[int]


def parse(page: str) -> Tree:
    tree = Tree([-1], ["#root"], [()], [None], [0], [0], [0])
    # open elements: name, block node (or the block it is inside)
    stack: list[tuple[str, int]] = [("#root", 0)]
    runs: list[str] = []
    links = [0, 0]
    held = 0
    #: open drawings and formulas: everything in them is inline
    foreign = 0

    def flush() -> None:
        nonlocal runs, held
        if runs:
            text = _SPACE.sub(" ", "".join(runs)).strip()
            if text:
                tree.parent.append(stack[-1][1])
                tree.tag.append("#text")
                tree.names.append(())
                tree.text.append(text)
                tree.size.append(len(text))
                tree.linked.append(min(held, len(text)))
                tree.ends.append(len(_END.findall(text)))
        runs, held = [], 0

    def say(raw: str) -> None:
        nonlocal held
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            runs.append(text)
            if links[0]:
                held += len(text.strip())

    def pop(upto: int) -> None:
        nonlocal foreign
        while len(stack) > upto:
            if stack[-1][0] == "a":
                links[0] = max(links[0] - 1, 0)
            foreign -= stack[-1][0] in FOREIGN
            stack.pop()

    def last(names: tuple[str, ...], stop: frozenset | tuple = ()) -> int:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                return at
            if stack[at][0] in stop:
                return 0
        return 0

    at, end = 0, len(page)
    while at < end:
        found = page.find("<", at)
        if found < 0:
            say(page[at:])
            break
        say(page[at:found])
        match = _TAG.match(page, found)
        if match is None:
            say("<")
            at = found + 1
            continue
        at = match.end()
        name = (match.group(2) or "").lower()
        if not name or not match.group(4):
            # a comment, a declaration, or a tag that the page's end cuts off
            continue
        if match.group(1):
            if name in FOREIGN or foreign and name not in BREAKS_OUT:
                spot = last((name,), LEAF_OF if not foreign else ())
                if spot:
                    pop(spot)
                continue
            if name in INLINE:
                spot = last((name,), LEAF_OF)
                if spot:
                    # inline elements hold no blocks of their own: only the element itself closes
                    if name == "a":
                        links[0] = max(links[0] - 1, 0)
                    del stack[spot]
                continue
            spot = last((name,))
            if spot:
                flush()
                pop(spot)
            continue
        if foreign and name in BREAKS_OUT:
            pop(next(n for n, (held_name, _) in enumerate(stack) if held_name in FOREIGN))
        if name == "br":
            runs.append(" ")
            continue
        if name in FOREIGN or foreign and name not in RAW:
            if not match.group(3).endswith("/"):
                foreign += name in FOREIGN
                stack.append((name, stack[-1][1]))
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in INLINE:
            if name == "a":
                links[0] += 1
            stack.append((name, stack[-1][1]))
            continue
        flush()
        if name not in CHOICES:
            spot = last(("select",))
            if spot:
                pop(spot)
        spot = last(("p",), ("td", "th", "li", "blockquote", "div", "article", "section"))
        if spot:
            pop(spot)
        if name in CLOSES:
            spot = last(CLOSES[name], ("ul", "ol", "dl", "table"))
            if spot:
                pop(spot)
        names = []
        for held_name in _NAMES.finditer(match.group(3)):
            names += _PART.findall((held_name.group(2) or held_name.group(3) or held_name.group(4) or "").lower())
        tree.parent.append(stack[-1][1])
        tree.tag.append(name)
        tree.names.append(tuple(names))
        tree.text.append(None)
        tree.size.append(0)
        tree.linked.append(0)
        tree.ends.append(0)
        stack.append((name, len(tree.tag) - 1))
    flush()
    for node in range(len(tree.tag) - 1, 0, -1):
        above = tree.parent[node]
        tree.size[above] += tree.size[node]
        tree.linked[above] += tree.linked[node]
        tree.ends[above] += tree.ends[node]
    return tree


def node_features(tree: Tree, node: int) -> list[str]:
    size, linked = tree.size[node], tree.linked[node]
    found = [f"tag={tree.tag[node]}", f"size={min(int(log2(1 + size)), 9)}", f"links={int(4 * linked / size) if size else 'none'}"]
    found.append(f"ends={min(tree.ends[node], 2)}")
    if tree.tag[node] == "#text":
        found.append(f"in={tree.tag[tree.parent[node]]}")
    return found + [f"name={name}" for name in tree.names[node]]


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    #: weight of the state content, by feature
    unary: np.ndarray
    #: (kind of child, state of parent, state of child), kind 0 containers, 1 leaves
    pair: np.ndarray


class Forest:
    """Trees side by side, so that messages of one depth are one array operation."""

    def __init__(self, trees: list[Tree], features: dict[str, int]):
        parents, depth, kind, rows, columns = [], [], [], [], []
        self.first = [0]
        for tree in trees:
            base = self.first[-1]
            own: list[int] = []
            for node, above in enumerate(tree.parent):
                parents.append(base + above if above >= 0 else -1)
                own.append(own[above] + 1 if above >= 0 else 0)
                kind.append(int(tree.tag[node] == "#text"))
                for name in node_features(tree, node):
                    at = features.get(name)
                    if at is not None:
                        rows.append(base + node)
                        columns.append(at)
            depth += own
            self.first.append(base + len(own))
        self.parent, self.depth, self.kind = np.array(parents), np.array(depth), np.array(kind)
        self.rows, self.columns = np.array(rows, np.int64), np.array(columns, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def marginals(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent state, child state) of each node with a parent."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.rows, weights=model.unary[self.columns], minlength=n)
        up = np.zeros((n, 2))
        inside = own.copy()
        for level in reversed(self.levels):
            joint = model.pair[self.kind[level]] + inside[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(inside, self.parent[level], up[level])
        # what a node hears from above
        down = np.zeros((n, 2))
        joint_of = np.zeros((n, 2, 2))
        for level in self.levels:
            above = self.parent[level]
            rest = inside[above] + down[above] - up[level]
            joint = rest[:, :, None] + model.pair[self.kind[level]]
            down[level] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            whole = joint + inside[level][:, None, :]
            whole = np.exp(whole - whole.max(axis=(1, 2), keepdims=True))
            joint_of[level] = whole / whole.sum(axis=(1, 2), keepdims=True)
        belief = inside + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint_of


def train(pages: list[tuple[str, str]], rounds: int = 250) -> Model:
    """Fit on (page, marked page) pairs; see `labelled_pages` for the marks."""
    trees, states = [], []
    for page, marks in pages:
        tree = parse(page)
        trees.append(tree)
        states.append(_states(tree, marks))
    names = sorted({name for tree in trees for node in range(len(tree.tag)) for name in node_features(tree, node)})
    features = {name: at for at, name in enumerate(names)}
    forest = Forest(trees, features)
    truth = np.concatenate(states).astype(float)
    child = np.flatnonzero(forest.parent >= 0)
    model = Model(features, np.zeros(len(names)), np.zeros((2, 2, 2)))
    seen_pair = np.zeros((2, 2, 2))
    np.add.at(seen_pair, (forest.kind[child], truth[forest.parent[child]].astype(int), truth[child].astype(int)), 1)
    seen = np.bincount(forest.columns, weights=truth[forest.rows], minlength=len(names))
    moment = [(np.zeros_like(model.unary), np.zeros_like(model.unary)), (np.zeros_like(model.pair), np.zeros_like(model.pair))]
    for step in range(1, rounds + 1):
        content, joint = forest.marginals(model)
        expected = np.bincount(forest.columns, weights=content[forest.rows], minlength=len(names))
        expected_pair = np.zeros((2, 2, 2))
        np.add.at(expected_pair, forest.kind[child], joint[child])
        gradients = (seen - expected - 0.05 * model.unary, seen_pair - expected_pair - 0.05 * model.pair)
        for value, gradient, (a, b) in zip((model.unary, model.pair), gradients, moment, strict=True):
            a *= 0.9
            a += 0.1 * gradient
            b *= 0.99
            b += 0.01 * gradient**2
            value += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return model


def _states(tree: Tree, marks: str) -> np.ndarray:
    """1 for leaves whose text is marked content and for the containers above them that hold more content than other text."""
    content, size = np.zeros(len(tree.tag)), np.zeros(len(tree.tag))
    for node in range(len(tree.tag) - 1, -1, -1):
        if tree.text[node] is not None:
            size[node] = len(tree.text[node])
            content[node] = size[node] * (marks in tree.text[node])
        if node:
            content[tree.parent[node]] += content[node]
            size[tree.parent[node]] += size[node]
    return (content > 0.5 * size).astype(np.int64)


#: The mark that a word of every content leaf of a labelled page carries.
MARK = "zqx"


def labelled_pages(count: int = 600, seed: int = 5) -> list[tuple[str, str]]:
    """Pages of the usual parts in varied layouts; every content block holds MARK as a word."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p

    def said(low: int, high: int, mark: bool) -> str:
        sentences = []
        left = rng.randint(low, high)
        while left > 0:
            n = min(left, rng.randint(4, 14))
            left -= n
            sentences.append(" ".join("".join(pick("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + pick(["."] * 8 + ["!", "?"]))
        words = " ".join(sentences)
        return f"{MARK} {words}" if mark else words

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{said(1, 1, False)}">{said(1, 3, False)[:-1]}</a></li>' for _ in range(rng.randint(low, high)))

    def named(words: str) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(words.split())}"'

    def menu() -> str:
        return pick([f"<nav><ul>{links(3, 9)}</ul></nav>", f"<div{named('nav menu navbar navigation topnav')}><ul>{links(3, 9)}</ul></div>", f'<ul role="navigation">{links(3, 8)}</ul>'])

    def header() -> str:
        return pick(["<header>{}</header>", "<div" + named("header masthead banner top site-header") + ">{}</div>"]).format(f"<h1>{said(1, 3, False)}</h1><p>{said(3, 9, False)}</p>" if chance(0.5) else f"<a href='/'>{said(1, 3, False)}</a>")

    def footer() -> str:
        return pick(["<footer>{}</footer>", "<div" + named("footer bottom site-footer copyright legal") + ">{}</div>"]).format(pick([f"&copy; {said(3, 12, False)}", f"<p>&copy; {said(4, 20, False)}</p>", f"<ul>{links(3, 6)}</ul><p>{said(3, 8, False)}</p>"]))

    def sidebar() -> str:
        return pick(["<aside>{}</aside>", "<div" + named("sidebar side widget related recommended share social") + ">{}</div>"]).format(f"<h3>{said(1, 3, False)}</h3>" + pick([f"<ul>{links(3, 7)}</ul>", f"<p>{said(6, 30, False)}</p>"]))

    def advert() -> str:
        return f"<div{named('ad ads advert advertisement sponsored promo banner-ad')}>{pick([said(4, 25, False), '<p>' + said(4, 25, False) + '</p>', '<a href=x>' + said(3, 9, False) + '</a>'])}</div>"

    def notice() -> str:
        return f"<div{named('notice cookie cookie-notice alert consent newsletter subscribe message')}>{pick([said(6, 30, False), '<p>' + said(6, 30, False) + '</p>'])}</div>"

    def choice() -> str:
        return "<select name=s>" + "".join(f"<option>{said(1, 3, False)}</option>" for _ in range(rng.randint(2, 5))) + "</select>"

    def form() -> str:
        inside = f"<label>{said(1, 3, False)}</label>{choice() if chance(0.3) else ''}<input name=q><button>{said(1, 2, False)}</button>"
        return f"<form action='/s'>{inside}" + (f"<p>{said(4, 12, False)}</p>" if chance(0.5) else "") + "</form>"

    def unseen() -> str:
        return pick(["<noscript>{}</noscript>", "<noscript><p>{}</p></noscript>", "<template><div>{}</div></template>", "<template><p>{}</p></template>"]).format(said(3, 20, False))

    def comments() -> str:
        one = lambda: pick(["<div class=\"comment\"><p>{}</p></div>", "<li class=\"comment-body\"><p>{}</p></li>", "<article class=\"comment\"><p>{}</p></article>"]).format(said(4, 60, False))
        inside = f"<h3>{said(1, 3, False)}</h3>" + "".join(one() for _ in range(rng.randint(1, 4)))
        return pick(["<section{}>{}</section>", "<div{}>{}</div>"]).format(named("comments comment-list replies discussion responses disqus"), inside)

    def block() -> str:
        kind = rng.random()
        text = said(*pick([(0, 3), (1, 8), (8, 40), (30, 160)]), True)
        if chance(0.15):
            spot = text.find(" ", len(text) // 2)
            text = f"{text[:spot]} <a href='/x'>{text[spot + 1:]}</a>" if spot > 0 else text
        if kind < 0.68:
            return f"<p>{'<b>' if chance(0.1) else ''}{text}</p>"
        if kind < 0.76:
            return f"<h2>{said(1, 7, True)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{said(2, 20, True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.95:
            return f"<table><tr><td>{said(1, 8, True)}</td><td>{said(1, 8, True)}</td></tr></table>"
        return f"<pre>{text}</pre>"

    def article() -> str:
        body = "".join(block() for _ in range(rng.randint(1, 12) if chance(0.75) else rng.randint(1, 2)))
        title = f"<h1>{said(1, 9, True)}</h1>"
        if chance(0.12):
            title = f"<header>{title}</header>"
        if chance(0.2):
            body += pick([advert, sidebar, form, notice])() + block()
        if chance(0.12):
            # closed, or left open before more of the article
            body += pick([unseen, unseen, choice, lambda: "<noscript>", lambda: "<select>", lambda: "<template>"])() + block() + block()
        if chance(0.12):
            # as short as a page's article can be
            title, body = "", f"<p>{said(0, 2, True)}</p>"
        whole = title + body if chance(0.85) else body
        shape = rng.random()
        if shape < 0.45:
            return f"<article>{whole}</article>"
        if shape < 0.6:
            return f"<main>{whole}</main>"
        if shape < 0.7:
            return f"<main><article>{whole}</article></main>"
        names = named("content article post entry story main body text article-body post-content entry-content main-content")
        return pick(["<div{}>{}</div>", "<section{}>{}</section>"]).format(names, whole)

    pages = []
    for _ in range(count):
        before = [part() for part in (menu, header, notice, advert, form) if chance(0.5)] + [unseen() for _ in range(1) if chance(0.1)]
        after = [part() for part in (comments, sidebar, advert, notice, footer, form) if chance(0.5)]
        rng.shuffle(before)
        body = "".join(before) + article() + "".join(after)
        if chance(0.25):
            body = f"<div{named('wrapper page container site')}>{body}</div>"
        page = f"<!DOCTYPE html><html><head><title>{said(2, 8, False)}</title></head><body>{body}</body></html>"
        pages.append((page[: rng.randint(len(page) // 2, len(page))] if chance(0.1) else page, MARK))
    return pages


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages())


def extract(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(page) for page in pages]
    forest = Forest(trees, model.features)
    content, _ = forest.marginals(model)
    found = []
    for at, tree in enumerate(trees):
        base = forest.first[at]
        found.append("\n\n".join(text for node, text in enumerate(tree.text) if text is not None and content[base + node] > 0.5))
    return found


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page row."""
    chosen = model or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(start, BATCH_PAGES)
                texts = extract([x.as_py() or "" for x in part.column(2)], chosen)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html_"))
    return mapped(own, work, "page_id long, url string, text string, n_chars long")

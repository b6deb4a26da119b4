"""HTML main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the
path of open tags and their class words. A bidirectional LSTM in numpy reads
the whole sequence of blocks, each as a vector of its hashed tag path, its
hashed words and a few figures, and gives every block the probability of being
main text; blocks of 0.5 or more are joined in page order.

The pages carry no labels. The labeller is trained on at most ``TRAIN_PAGES``
pages (those with the smallest hashes), where a block's label comes from its
path (``path_label``), and on rearranged copies of them, in which the same text
stands under other containers and between other page furniture, in lists, tables,
sub-headings and captions as well as paragraphs, so that the labeller does not
depend on one site's markup. It then labels by itself. Of a training sequence of
more than ``TRAIN_BLOCKS`` blocks the fit sees the first and last ones; every
page is labelled over all its blocks. Reading a page takes time linear in it: a
path is a chain of open elements, each with the sums of those above it.

Defined cases: a null or empty html has no block and gives an empty text;
unclosed or stray tags are repaired as browsers do (a block tag ends a
paragraph, an end tag ends what stands inside it, text or an element that
cannot stand in the head ends an open head); repeated rows give repeated rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airops.llm import textops
from airops.llm.common import bound_batches, read_table, schema, smallest_hashes

TRAIN_PAGES, COPIES = 400, 3
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 96, 24, 8, 20
EPOCHS, BATCH, TRAIN_BLOCKS, RATE = 12, 32, 64, 0.01
DIM = PATH_DIM + WORD_DIM + FIGURES

# HTML elements by how they are laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr img br input".split())
NOT_SHOWN = set("script style noscript noframes template textarea title iframe object svg math canvas audio video "
                "select datalist".split())
FOREIGN = {"svg", "math"}  # only these can close themselves
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSED_BY_SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"},
                     "th": {"tr"}, "option": {"select"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+)>"
                  r"|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

#: Names in a path that mark page furniture, and those that mark the main text.
FURNITURE = set("nav menu header footer aside sidebar side form button search login signin signup comment comments "
                "reply replies disqus discussion respond ad ads advert adverts advertisement advertising sponsor "
                "sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe "
                "subscription related recommended recommendations more share sharing social breadcrumb breadcrumbs "
                "crumbs pagination pager widget popup modal overlay toolbar masthead copyright legal skip toc tags "
                "navigation navbar topbar dialog complementary contentinfo hidden paywall teaser links".split())
MAIN = set("article main content post entry story body text articlebody maincontent page".split())


class Element:
    """An open element: its entry ("tag name name"), what it stands in, and what
    the chain up to it says (so that deep pages need no walk along it)."""

    __slots__ = ("up", "entry", "depth", "head", "furniture", "main", "vector")

    def __init__(self, up: Element | None, entry: str) -> None:
        tag, *names = entry.split()
        words = {tag, *names}
        self.up, self.entry = up, entry
        self.depth = up.depth + 1 if up else 1
        self.head = tag == "head" or bool(up and up.head)
        self.furniture = not FURNITURE.isdisjoint(words) or bool(up and up.furniture)
        self.main = not (MAIN - {"body"}).isdisjoint(words) or "body" in names or bool(up and up.main)
        self.vector: np.ndarray | None = None


def chain(entries: Sequence[str]) -> Element | None:
    at = None
    for entry in entries:
        at = Element(at, entry)
    return at


@dataclass
class Block:
    text: str
    at: Element | None  # the innermost element that the text stands in
    linked: int  # characters of the text inside links

    @property
    def path(self) -> tuple[str, ...]:
        """The entries of the open elements, from the outermost."""
        out, e = [], self.at
        while e:
            out.append(e.entry)
            e = e.up
        return tuple(reversed(out))


def _names(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    words = [w.lower() for m in _ATTRIBUTE.finditer(attributes)
             for w in _NAME.findall(m[2] or m[3] or m[4] or "")]
    return " ".join([tag, *words])


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, Element | None]] = []  # inline tags have no element
    opened: Counter[str] = Counter()  # tags on the stack
    unended: set[str] = set()  # tags that no end tag follows any more
    text: list[str] = []
    linked = links = at = 0
    in_body = False

    def inside() -> Element | None:
        return next((e for _, e in reversed(stack) if e), None)

    def close() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, inside(), min(linked, len(joined))))
        text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        for t, _ in stack[k:]:
            links -= t == "a"
            opened[t] -= 1
        del stack[k:]

    def begin_body() -> None:
        nonlocal in_body
        in_body = True
        for k in range(len(stack)):
            if stack[k][0] == "head":
                close()
                pop_to(k)
                break

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        piece = html[at:m.start() if m else n]
        if piece:
            if not in_body and piece.strip(" \t\n\f\r"):
                begin_body()
            text.append(piece)
            if links > 0:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not in_body and (tag in ("body", "html", "br") if ends else tag not in IN_HEAD | {"html", "head"}):
            begin_body()
        if tag == "head" and not ends and (in_body or opened["head"]):
            continue
        if tag in NOT_SHOWN and not ends:
            if tag not in FOREIGN or not attributes.endswith("/"):
                end = None if tag in unended else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if not end:
                    unended.add(tag)
                at = end.end() if end else (n if tag in ("script", "style", "title", "textarea") else at)
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag in VOID:
                pass
            elif not ends:
                stack.append((tag, None))
                opened[tag] += 1
                links += tag == "a"
            elif opened[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        links -= tag == "a"
                        opened[tag] -= 1
                        del stack[k]
                        break
                    if stack[k][1]:
                        break
            continue
        close()
        if ends:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
            if stack[k][0] == "p":
                pop_to(k)
                break
            if stack[k][1]:
                break
        if tag in CLOSED_BY_SIBLING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in CLOSED_BY_SIBLING[tag]:
                    break
        if not attributes.endswith("/") or tag not in VOID:
            stack.append((tag, Element(inside(), _names(tag, attributes))))
            opened[tag] += 1
    close()
    return [b for b in out if not b.at or not b.at.head]


def path_label(block: Block) -> int:
    """1 for main text, as far as the path (or, without hints, the text) tells."""
    if block.at and block.at.furniture:
        return 0
    if block.at and block.at.main:
        return 1
    return int(block.linked < 0.3 * len(block.text) and len(block.text.split()) >= 8)


def _bucket(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return (h >> 1) % dim, 1.0 if h & 1 else -1.0


class Vectors:
    """Block vectors; the vector of an entry is worked out once, that of a path
    from the one above it."""

    def __init__(self) -> None:
        self.entries: dict[str, np.ndarray] = {}

    def entry(self, entry: str) -> np.ndarray:
        v = self.entries.get(entry)
        if v is None:
            v = np.zeros(PATH_DIM, dtype=np.float32)
            for word in entry.split():
                at, sign = _bucket(word, PATH_DIM)
                v[at] += sign
            if len(self.entries) < 50_000:
                self.entries[entry] = v
        return v

    def path(self, at: Element | None) -> np.ndarray:
        todo = []
        while at and at.vector is None:
            todo.append(at)
            at = at.up
        v = at.vector if at else np.zeros(PATH_DIM, dtype=np.float32)
        for e in reversed(todo):
            v = e.vector = v + self.entry(e.entry)
        return v

    def of(self, found: Sequence[Block]) -> np.ndarray:
        x = np.zeros((len(found), DIM), dtype=np.float32)
        texts = [b.text.encode("utf-8", "surrogatepass").lower() for b in found]
        for lo, hi in textops.steps(texts):
            w = textops.Words(texts[lo:hi])
            count = np.diff(w.first)
            row = np.repeat(np.arange(lo, hi), count)
            at = PATH_DIM + (w.hash % np.uint64(WORD_DIM)).astype(np.int64)
            sign = ((w.hash >> np.uint64(40)) & np.uint64(1)).astype(np.float32) * 2 - 1
            np.add.at(x, (row, at), sign)
            x[lo:hi, PATH_DIM:PATH_DIM + WORD_DIM] /= np.sqrt(np.maximum(count, 1))[:, None]
            x[lo:hi, -1] = np.log1p(count) / 4
        n = max(1, len(found))
        for i, b in enumerate(found):
            x[i, :PATH_DIM] = self.path(b.at)
            size = len(b.text)
            x[i, -FIGURES:-1] = (b.linked / size, np.log1p(size) / 6, b.text[-1] in ".!?…\"”»", i / n,
                                 min(b.text.count(",") / 10, 1), (b.at.depth if b.at else 0) / 10, b.text[:1].isupper())
        return np.clip(x, -4, 4)


# --- the network ---------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {}
    for d in "fb":
        net["W" + d] = rng.normal(0, 0.1, (DIM, 4 * HIDDEN))
        net["U" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        net["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    net["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
    net["a"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in net.items()}


def _run(x: np.ndarray, live: np.ndarray, net: dict, d: str) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, HIDDEN) of one direction over padded sequences."""
    steps, size, _ = x.shape
    h = c = np.zeros((size, HIDDEN), dtype=np.float32)
    pre = x @ net["W" + d] + net["c" + d]
    out, trace = np.zeros((steps, size, HIDDEN), dtype=np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ net["U" + d]
        gate = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = live[t][:, None]
        new = f * c + i * g
        s = np.tanh(new)
        trace.append((t, h, c, i, f, o, g, s, m))
        c = np.where(m, new, c)
        h = np.where(m, o * s, h)
        out[t] = h
    return out, trace


def probabilities(x: np.ndarray, live: np.ndarray, net: dict) -> np.ndarray:
    hf, _ = _run(x, live, net, "f")
    hb, _ = _run(x, live, net, "b")
    return _sigmoid(np.concatenate([hf, hb], axis=2) @ net["o"] + net["a"])


def _gradients(x: np.ndarray, y: np.ndarray, live: np.ndarray, net: dict) -> dict[str, np.ndarray]:
    hf, tf = _run(x, live, net, "f")
    hb, tb = _run(x, live, net, "b")
    both = np.concatenate([hf, hb], axis=2)
    p = _sigmoid(both @ net["o"] + net["a"])
    e = np.where(live, p - y, 0) / max(1, live.sum())
    grad = {"o": np.einsum("tb,tbh->h", e, both), "a": np.array([e.sum()])}
    out = e[:, :, None] * net["o"]
    for d, trace, part in (("f", tf, out[:, :, :HIDDEN]), ("b", tb, out[:, :, HIDDEN:])):
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        du = np.zeros_like(net["U" + d])
        dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        for t, h, c, i, f, o, g, s, m in reversed(trace):
            dh = dh + part[t]
            mine = np.where(m, dh, 0)
            dnew = np.where(m, dc + mine * o * (1 - s * s), 0)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), mine * s * o * (1 - o),
                                 dnew * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            du += h.T @ dz
            dh = np.where(m, dz @ net["U" + d].T, dh)
            dc = np.where(m, dnew * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad["W" + d] = x.reshape(-1, DIM).T @ flat
        grad["U" + d] = du
        grad["c" + d] = flat.sum(axis=0)
    return grad


def padded(sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, sequences))
    x = np.zeros((steps, len(sequences), sequences[0].shape[1]), dtype=np.float32)
    live = np.zeros((steps, len(sequences)), dtype=bool)
    for k, s in enumerate(sequences):
        x[:len(s), k] = s
        live[:len(s), k] = True
    return x, live


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean cross-entropy of the blocks."""
    net = new_network(seed)
    if not sequences:
        return net
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    n = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), BATCH):
            part = [sequences[k] for k in order[lo:lo + BATCH]]
            x, live = padded([s for s, _ in part])
            y, _ = padded([v[:, None].astype(np.float32) for _, v in part])
            n += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in _gradients(x, y[:, :, 0], live, net).items():
                g = np.clip(g, -1, 1).astype(np.float32)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] = net[k] - rate * (first[k] / (1 - 0.9 ** n)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** n)) + 1e-8)
    return net


# --- training sequences --------------------------------------------------

# Containers that rearranged pages use.
_MAIN_PATHS = (("body", "article"), ("body", "main", "article"), ("body", "div content"), ("body", "div post body"),
               ("body", "div wrapper", "div entry content"), ("body", "div page", "main"), ("body", "section story"),
               ("body", "div container", "div article body"), ("body", "div"), ("body", "div", "div"))
_FURNITURE_PATHS = (
    ("nav", "ul", "li"), ("div menu", "ul", "li"), ("header",), ("header", "div"), ("div header",), ("footer",),
    ("footer", "p"), ("div footer", "p"), ("aside",), ("aside", "p"), ("aside", "ul", "li"), ("div sidebar", "p"),
    ("div sidebar", "ul", "li"), ("div cookie notice", "p"), ("div cookie banner",), ("div notice",),
    ("div alert",), ("div consent",), ("div ad",), ("div ads", "p"), ("div advert", "p"), ("div advertisement",),
    ("div sponsored", "p"), ("div promo", "p"), ("form",), ("form", "p"), ("form", "label"), ("form", "button"),
    ("div newsletter", "p"), ("div subscribe", "form", "p"), ("section comments", "p"),
    ("section comments", "div comment", "p"), ("div comments", "ol", "li comment", "p"), ("div comment", "p"),
    ("ul comments", "li"), ("div related", "ul", "li"), ("div share",), ("div social", "ul", "li"),
    ("div breadcrumbs",), ("div pagination",), ("div widget", "p"), ("div popup", "p"), ("button",))
_LEAVES = (("p",), ("div",), ("div", "p"), ("section", "p"), ("ul", "li"), ("ol", "li"), ("ul", "li", "p"),
           ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("table", "thead", "tr", "th"), ("dl", "dt"),
           ("dl", "dd"), ("pre",), ("blockquote",), ("blockquote", "p"), ("h2",), ("h3",), ("h4",),
           ("figure", "figcaption"), ("details", "summary"), ("table", "caption"))


def rearranged(found: list[Block], seed: int) -> list[tuple[Block, int]]:
    """A copy of a page: its main blocks under another container, between new
    furniture whose text is taken from the page."""
    rng = random.Random(seed)
    main = [b for b in found if path_label(b)]
    words = " ".join(b.text for b in found).split() or ["a"]
    base = rng.choice(_MAIN_PATHS)

    main_words = " ".join(b.text for b in main).split() or words

    def leaf(b: Block) -> str:
        tag = b.path[-1].split()[0] if b.at else "p"
        return tag if tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") else "p"

    def passage(source: list[str], sizes: tuple[int, ...]) -> str:
        n, k = rng.choice(sizes), rng.randrange(len(source))
        return " ".join(source[k:k + n])

    def furniture(inside: bool) -> list[tuple[Block, int]]:
        path = rng.choice(_FURNITURE_PATHS)
        if rng.random() < 0.4:  # any element can stand in furniture
            path = (path[0], *rng.choice(_LEAVES))
        at = chain(("html", *(base if inside else base[:1]), *path))
        out = []
        for _ in range(rng.randint(1, 6)):
            text = passage(words, (1, 1, 2, 3, 5, 8, 15, 40))
            out.append((Block(text, at, len(text) if path[-1].startswith("li") and rng.random() < 0.7 else 0), 0))
        return out

    def content() -> list[tuple[Block, int]]:
        """A list, table, heading, caption and the like of the article."""
        at = chain(("html", *base, *rng.choice(_LEAVES)))
        return [(Block(passage(main_words, (1, 2, 3, 5, 8, 15, 30)), at, 0), 1) for _ in range(rng.randint(1, 4))]

    out = []
    for _ in range(rng.randint(1, 4)):
        out += furniture(False)
    for b in main:
        out.append((Block(b.text, chain(("html", *base, leaf(b))), b.linked), 1))
        if rng.random() < 0.25:
            out += content()
        if rng.random() < 0.08:
            out += furniture(True)
    for _ in range(rng.randint(1, 4)):
        out += furniture(rng.random() < 0.3)
    return out


def training_sequences(html: str) -> list[tuple[list[Block], list[int]]]:
    found = blocks(html)
    if not found:
        return []
    out = [(found, [path_label(b) for b in found])]
    seed = zlib.crc32(html.encode("utf-8", "surrogatepass"))
    for k in range(COPIES):
        both = rearranged(found, seed + k)
        if both:
            out.append(([b for b, _ in both], [y for _, y in both]))
    return out


def train(pages: DataFrame, html_col: str = "html") -> dict[str, np.ndarray]:
    """The network, fitted on a bounded sample of pages."""
    bound_batches(pages.sparkSession)
    keyed = pages.where(pages[html_col].isNotNull()).select(F.xxhash64(html_col).alias("h"))
    picked = F.broadcast(smallest_hashes(keyed.distinct(), TRAIN_PAGES, "h"))  # bounded by the limit
    rows = pages.select(F.xxhash64(html_col).alias("h"), pages[html_col].alias("html")).join(picked, "h")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Vectors()
        for pdf in batches:
            out = []
            for h, html in zip(pdf["h"], pdf["html"]):
                for k, (found, y) in enumerate(training_sequences(html)):
                    # a long page gives its first and last blocks to the training only
                    pick = range(len(y)) if len(y) <= TRAIN_BLOCKS else [
                        *range(TRAIN_BLOCKS // 2), *range(len(y) - TRAIN_BLOCKS // 2, len(y))]
                    x = make.of(found)[list(pick)].astype(np.float16)
                    out.append((h, k, x.tobytes(), bytes(y[i] for i in pick)))
            yield pd.DataFrame(out, columns=["h", "k", "x", "y"])

    made = rows.mapInPandas(vectors, schema(("h", "bigint"), ("k", "int"), ("x", "binary"), ("y", "binary")))
    got = made.groupBy("h", "k").agg(F.max("x").alias("x"), F.max("y").alias("y")).toPandas()
    got = got.sort_values(["h", "k"])
    return fit([(np.frombuffer(x, dtype=np.float16).reshape(-1, DIM).astype(np.float32),
                 np.frombuffer(y, dtype=np.uint8)) for x, y in zip(got["x"], got["y"])])


def label_pages(net: dict, pages: list[list[Block]], make: Vectors, group: int = 128) -> list[np.ndarray]:
    """The probability of each block of each page; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        most = max(1, min(group, 40_000 // len(pages[order[-1]])))
        part, order = order[-most:], order[:-most]
        x, live = padded([make.of(pages[i]) for i in part])
        p = probabilities(x, live, net)
        for k, i in enumerate(part):
            out[i] = p[:len(pages[i]), k]
    return out


def extract_text(pages: DataFrame, net: dict, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(net)
    picked = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Vectors()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                found = [blocks(h) if isinstance(h, str) else [] for h in part["html"]]
                p = label_pages(shared.value, found, make)
                text = [" ".join(b.text for b, v in zip(f, q) if v >= 0.5) for f, q in zip(found, p)]
                yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "text": text,
                                    "n_chars": [len(t) for t in text]})

    return picked.mapInPandas(run, schema(
        ("page_id", picked.schema["page_id"].dataType), ("url", picked.schema["url"].dataType),
        ("text", "string"), ("n_chars", "bigint")))


def op9_html_bilstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages`` from its whole html."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, train(pages))

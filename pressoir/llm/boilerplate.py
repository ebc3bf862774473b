"""Problem 7: page boilerplate mixed with main content, by composite text density over the page's node tree."""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hash_sample, spread

#: Most pages with frame mark-up, with article mark-up only, and of any kind that the link model is fitted on, and the longest page of that
#: sample in characters; together the bound of what comes to the driver. The operator itself reads every page whole.
FRAMED_PAGES, MARKED_PAGES, OTHER_PAGES, SAMPLE_CHARS = 700, 150, 600, 20_000

TAG = re.compile(r"<!--.*?(?:-->|$)|</?[a-zA-Z][^<>]*(?:>|$)")
#: Mark-up that by HTML's own terms makes a line navigation: a landmark, a layout cell, a list entry that is nothing but a link within the site.
FRAMED = re.compile(r'\s*(?:<(?:nav|footer|aside|form|header)\b|<div\s+(?:class|id)="?(?:nav|menu|foot|pied|head|entete|side|banner|breadcrumb)|<t[dr]\b|<table\b|<li[^>]*>\s*<a\s[^>]*href="?/)', re.I)
FRAMED_SQL = r'(?i)(^|\n)\s*(<(nav|footer|aside|form|header)\b|<div\s+(class|id)="?(nav|menu|foot|pied|head|entete|side|banner|breadcrumb)|<td\b|<li[^>]*>\s*<a\s[^>]*href="?/)'
#: Mark-up of running text.
MARKED = re.compile(r"\s*</?(?:p|h[1-6]|pre|ul|ol|dl|blockquote|code|syntaxhighlight|math|article)\b", re.I)
MARKED_SQL = r"(?i)(^|\n)\s*<(p|h[1-6])\b"
#: Opening of list entries, trees, code and other blocks that are no links.
ENTRY = re.compile(r"\s*(?:[–•├│└\\#~=*+`]|- \[)\S*\s|\s*(?:```|~~~)|\s{2,}\S")
_digits = re.compile(r"\d+")
_atom = re.compile(r"[a-z]+|0|[|·>/»©:?=(]")
_end = re.compile(r"[.!?…][\s»\"')]*$")
_shut = re.compile(r"\s*</div", re.I)
_div = re.compile(r"\s*<div", re.I)


class Line:
    """A leaf of the page: its number, text, atoms (runs of plain letters, so that a wrong encoding changes little), kind and mark-up."""

    __slots__ = ("number", "raw", "words", "tags", "atoms", "kind", "follows", "own", "label")

    def __init__(self, number: int, raw: str):
        self.number, self.raw, self.tags = number, raw, 0
        words = raw
        if "<" in raw:
            words, self.tags = TAG.subn(" ", raw)
        if "&" in words:
            words = html.unescape(words)
        self.words = words = words.strip()
        self.atoms = _atom.findall(_digits.sub("0", words.lower()))
        if len(words) > 55 and _end.search(words):
            self.kind = "sentence"
        else:
            self.kind = "bare" if not self.atoms else "entry" if ENTRY.match(raw) or ENTRY.match(words) else "short" if len(words) <= 110 else "long"
        self.follows, self.own, self.label = "end", 0, None


def read(page: str) -> list[Line]:
    """The non-blank lines of a page. ``own`` tells how many of a short line's words the page's sentences share among themselves."""
    lines = [Line(i, raw) for i, raw in enumerate(page.split("\n")) if raw.strip()]
    held: Counter = Counter()
    sentences = 0
    for x in lines:
        if x.kind == "sentence":
            sentences += 1
            held.update({t for t in x.atoms if len(t) > 4})
    least = max(2, 0.25 * sentences)
    topic = {t for t, n in held.items() if n >= least}
    inside: list[int] = []
    for k, x in enumerate(lines):
        if k + 1 < len(lines):
            x.follows = lines[k + 1].kind
        if x.kind != "sentence":
            x.own = min(2, len({t for t in x.atoms if len(t) > 4} & topic))
        if x.tags:
            if not x.words and _shut.match(x.raw):
                x.label = inside.pop() if inside else 1
            else:
                x.label = 1 if FRAMED.match(x.raw) else 0 if MARKED.match(x.raw) else None
                if not x.words and _div.match(x.raw):
                    inside.append(x.label or 0)
    return lines


def shape(x: Line) -> list:
    """Features of a line by itself."""
    a = x.atoms
    out: list = [*set(a), *set(zip(a, a[1:]))]
    if a:
        out += [("^", a[0]), (a[-1], "$")]
    out += [("size", min(len(x.words) // 20, 9)), ("atoms", min(len(a), 9)), ("kind", x.kind), ("own", x.own), ("follows", x.kind, x.follows)]
    if " – " in x.words or " - " in x.words:
        out.append("dash")
    return out


def context(x: Line, before: Line | None, linked: int | None, opener: tuple) -> list:
    """Features of a line next to the line before, which is a link (1), text (0) or missing (None); ``opener`` is the end of the last line that is a link by its own words."""
    last = ("last", linked, *before.atoms[-2:]) if before is not None and len(before.words) < 45 else ("last", linked)
    return [("after", linked), ("after", linked, x.kind, x.own), ("after", linked, x.kind, x.own, x.follows), last, ("opener", linked, opener, x.kind, min(x.own, 1))]


class Links:
    """Chance that a line is a link or other frame: a logistic chain over a page's lines."""

    def __init__(self, weights: dict, bias: float):
        self.weights, self.bias, self.seen = weights, bias, {}

    def own(self, x: Line) -> float:
        """Log odds of a line by itself; short lines recur, so theirs are kept."""
        if x.kind == "sentence":
            get = self.weights.get
            return self.bias + sum([get(f, 0.0) for f in shape(x)])
        key = (x.words, x.kind, x.own, x.follows)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            get = self.weights.get
            got = self.seen[key] = self.bias + sum([get(f, 0.0) for f in shape(x)])
        return got

    def shares(self, lines: list[Line]) -> list[float]:
        """The chance of each line, from the first on; mark-up that labels a line goes first."""
        get, out, p, before, opener = self.weights.get, [], None, None, ()
        for x in lines:
            z = None
            if x.label is not None:
                q = float(x.label)
            else:
                z = self.own(x)
                at = lambda linked: _chance(z + sum([get(f, 0.0) for f in context(x, before, linked, opener)]))  # noqa: B023, E731
                if p is None:
                    q = at(None)
                else:
                    q = (p * at(1) if p > 0.02 else 0.0) + ((1 - p) * at(0) if p < 0.98 else 0.0)
            out.append(q)
            if q > 0.5 and x.kind != "bare" and (z if z is not None else self.own(x)) > 0:
                opener = tuple(x.atoms[-2:])
            p, before = q, x
        return out


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if -30 < z < 30 else float(z > 0)


def fit(examples: list[tuple[list, float, float]], steps: int = 60, decay: float = 2e-6) -> Links:
    """Logistic model of (features, link or not, weight): full-batch gradient steps scaled as in AdaGrad, the same for the same examples."""
    counts = Counter(f for fs, _, _ in examples for f in fs)
    index = {f: i for i, f in enumerate(f for f, n in counts.items() if n > 1)}
    rows = [[index[f] for f in fs if f in index] for fs, _, _ in examples]
    if not rows:
        return Links({}, -1.0)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), "int64", len(at))
    y = np.array([e[1] for e in examples]) * 0.98 + 0.01
    share = np.array([e[2] for e in examples])
    share = share / share.sum()
    w, b, grown, grown_b = np.zeros(len(index)), 0.0, np.full(len(index), 1e-7), 1e-4
    for _ in range(steps):
        z = np.bincount(at, w[flat], minlength=len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.bincount(flat, d[at], minlength=len(w)) + decay * w
        grown += g * g
        w -= 0.125 * g / np.sqrt(grown)
        grown_b += d.sum() ** 2
        b -= 0.1 * d.sum() / math.sqrt(grown_b)
    return Links({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 0.01}, float(b))


def examples_of(lines: list[Line], labels: list[float | None], sure: float = 1.0) -> list[tuple[list, float, float]]:
    """Examples of a page whose lines are labelled, as far as they are; each stands after the label before it."""
    out, linked, before, opener = [], None, None, ()
    for x, y in zip(lines, labels):
        if y is not None:
            hard = int(y > 0.5)
            out.append((shape(x) + context(x, before, linked, opener), float(hard), sure * (1.0 if abs(y - 0.5) > 0.4 else 0.3)))
            linked = hard
            if hard and x.kind not in ("bare", "sentence"):
                opener = tuple(x.atoms[-2:])
        before = x
    return out


def link_model_of(pages: list[str], rounds: int = 1) -> Links:
    """The link model of sample pages: fitted on the lines that mark-up labels, with list entries, code and sentences between
    sentences as text; then again with all pages as it reads them itself, so that words of plain pages come in."""
    read_pages = [lines for p in pages if (lines := read(p))]
    base, plain = [], []
    for lines in read_pages:
        labels: list[float | None] = [x.label for x in lines]
        if 1 in labels or 0 in labels:
            near = [next((y for y in labels[k + step :: step] if y is not None), None) if 0 <= k + step else None for k in range(len(lines)) for step in (-1, 1)]
            labels = [0.0 if y is None and (x.kind == "entry" or x.kind == "sentence" and near[2 * k] == near[2 * k + 1] == 0) else y for k, (x, y) in enumerate(zip(lines, labels))]
            base += examples_of(lines, labels)
        else:
            plain.append(lines)
    seeds = []
    for lines in plain:
        full = [k for k, x in enumerate(lines) if x.kind == "sentence"]
        for k, x in enumerate(lines):
            if x.kind == "entry" or full and full[0] < k < full[-1] and x.kind == "sentence":
                seeds.append((shape(x) + (context(x, lines[k - 1], 0, ()) if k and lines[k - 1].kind == "sentence" else []), 0.0, 1.0))

    def weighed(more: list, ratio: float) -> list:
        mass = sum(e[2] for e in more)
        scale = ratio * max(1, len(base)) / mass if mass else 0.0
        return base + [(f, y, w * scale) for f, y, w in more]

    model = fit(weighed(seeds, 1.0))
    for _ in range(rounds if base else 0):
        again = []
        for lines in plain:
            again += examples_of(lines, [0.0 if x.kind == "entry" else p for x, p in zip(lines, model.shares(lines))])
        model = fit(weighed(again, 3.0))
    return model


def density(chars: float, tags: float, links: float, linked_tags: float, ratio: float) -> float:
    """Composite text density of a node: characters per tag, adjusted by the shares of characters and tags that are links.

    ``links`` and ``linked_tags`` are the link characters and link tags, ``ratio`` the body's link characters per character.
    """
    if chars <= 0:
        return 0.0
    tags, linked, free = max(1.0, tags), max(1.0, links), max(1.0, chars - links)
    base = math.log(chars / free * links + ratio * chars + math.e)
    value = max(1.0, chars / linked * tags / max(1.0, linked_tags))
    return chars / tags * math.log(value) / max(math.log(base), 0.1)


class Node:
    """A node of the page's tree with its sums: characters, tags, link characters, link tags, density and the sum of its children's densities."""

    def __init__(self, thin: bool = False) -> None:
        self.thin = thin
        self.members: list[int] = []
        self.chars = self.tags = self.links = self.linked_tags = self.density = self.sum = 0.0

    def add(self, k: int, chars: float, tags: float, share: float, own: float) -> None:
        self.members.append(k)
        self.chars += chars
        self.tags += tags
        self.links += chars * share
        self.linked_tags += tags * share
        self.sum += own


#: Density below which a line is thin, a character of it and at most; share of the body-path threshold that a node must reach.
THIN_CHAR, THIN, PATH = 0.3, 9.0, 0.2


def frame_lines(page: str | None, links: Links) -> list[int]:
    """Numbers of the lines that are not part of the article, counted from 0; blank lines are never given.

    The page is a tree: the body, nodes, lines. A line's composite text density comes from its characters, its tags (each line is a
    block, hence one tag at least) and its link characters, that is its characters times the chance that it is a link. Neighbouring lines above the
    density of a thin line form one node, and so do neighbouring thin lines. The densities of a node's lines are summed; the node of largest sum
    is the article's core, and the path from it to the body gives the threshold, the least density on it. Nodes that reach the share PATH of
    the threshold are the article, with all their lines; all others are frame. A page all of whose lines are thin has no article.
    """
    lines = read(page) if page else []
    if not lines:
        return []
    shares = links.shares(lines)
    body = Node()
    for k, (x, p) in enumerate(zip(lines, shares)):
        body.add(k, len(x.words), x.tags + 1, p, 0.0)
    ratio = body.links / max(1.0, body.chars)
    body.density = density(body.chars, body.tags, body.links, body.linked_tags, ratio)
    # mark-up lines without words take the density of what they wrap
    own = [density(len(x.words), 1, len(x.words) * p, p, ratio) if x.words else (0.0 if p > 0.5 else math.inf) for x, p in zip(lines, shares)]
    nodes: list[Node] = []
    for k, (x, p, d) in enumerate(zip(lines, shares, own)):
        thin = d < min(THIN, THIN_CHAR * max(1, len(x.words)))
        if not nodes or nodes[-1].thin != thin:
            nodes.append(Node(thin))
        nodes[-1].add(k, len(x.words), x.tags + 1, p, 0.0 if d == math.inf else d)
    for n in nodes:
        n.density = density(n.chars, n.tags, n.links, n.linked_tags, ratio) if n.chars else (math.inf if own[n.members[0]] == math.inf else 0.0)
    core = max((n for n in nodes if not n.thin), key=lambda n: n.sum, default=None)
    threshold = min(body.density, core.density) if core else math.inf
    return [lines[k].number for n in nodes if n.density < PATH * threshold for k in n.members]


def link_model(pages: DataFrame, text: str = "texte") -> Links:
    """The link model, fitted on the driver on a sample of pages taken by hash: FRAMED_PAGES, MARKED_PAGES and OTHER_PAGES pages of at most SAMPLE_CHARS characters."""
    able = pages.where(F.length(text) <= SAMPLE_CHARS)
    framed, marked = F.col(text).rlike(FRAMED_SQL), F.col(text).rlike(MARKED_SQL)
    parts = [(able.where(framed), FRAMED_PAGES), (able.where(marked & ~framed), MARKED_PAGES), (able.where(~framed & ~marked), OTHER_PAGES)]
    return link_model_of([r[0] for rows, most in parts for r in hash_sample(rows, text, most).toLocalIterator()])


_models: dict[str, Links] = {}


def _shared(model: Links, pages: DataFrame):
    """The model as every worker reads it, once a process."""
    sent = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.weights, model.bias))

    def get() -> Links:
        name, weights, bias = sent.value
        if name not in _models:
            _models.clear()
            _models[name] = Links(weights, bias)
        return _models[name]

    return get


def boilerplate_lines(pages: DataFrame, key: str = "fichier", text: str = "texte") -> DataFrame:
    """(key, ligne) of every non-blank line that is not part of the article, repeated rows once.

    Pages are read whole, where they lie: no shuffle but to spread a scan of few partitions, and for distinct rows. Null and empty pages give no rows. A page all of
    whose lines are thin is frame altogether; one of which no line is gives none.
    """
    model = _shared(link_model(pages, text), pages)

    @F.pandas_udf("array<int>")
    def lines(texts: pd.Series) -> pd.Series:
        links = model()
        return texts.map(lambda t: frame_lines(t, links))

    return spread(pages.select(key, text)).where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.explode(lines(text)).alias("ligne")).distinct()


def main_text(pages: DataFrame, key: str = "fichier", text: str = "texte") -> DataFrame:
    """(key, texte, corps): each page with its article's own lines only, rows equal in key and text once; null pages give no rows."""
    model = _shared(link_model(pages, text), pages)

    @F.pandas_udf("string")
    def body(texts: pd.Series) -> pd.Series:
        links = model()

        def one(t: str) -> str:
            gone = set(frame_lines(t, links))
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone).strip("\n")

        return texts.map(one)

    once = pages.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.col(text).alias("texte")).dropDuplicates([key, "texte"])
    return once.withColumn("corps", body("texte"))

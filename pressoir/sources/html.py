"""Articles from HTML files, through a tolerant event parser of the standard library."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT

# Elements without an end tag, and which open elements a new one closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("table tr td th div ul ol dl h1 h2 h3 h4 h5 h6 form".split())


class Element:
    """A node of the tree: name, attributes, children (elements and strings) and parent."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def find_all(self, name: str, css: str | None = None) -> Iterator[Element]:
        return (n for n in self.walk() if n is not self and n.name == name and (css is None or css in n.attrs.get("class", "").split()))

    def find(self, name: str, css: str | None = None) -> Element | None:
        return next(self.find_all(name, css), None)

    def strings(self) -> Iterator[str]:
        stack: list[Element | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack += reversed(node.children)

    def text(self, sep: str = "") -> str:
        """Its text fragments, each stripped, empty ones left out, joined by ``sep``."""
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def up(self, name: str) -> Element | None:
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs) -> None:
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        node = self.at
        while node.parent is not None and node.name in closes | {"span", "a", "b", "i", "em", "strong", "font"}:
            if node.name in closes:
                self.at = node.parent
                closes = closes if tag == "tr" else set()
                if not closes:
                    break
            node = node.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            if node.name in ("table", "td") and tag not in ("table", "body", "html", "tr"):
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Element:
    """The tree of a document; unclosed elements are closed where HTML closes them, stray end tags are passed over."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def bulletin(html: str, path: str, all_images: bool = False) -> dict:
    """The nine fields of an article page of the archive's layout; a field whose mark-up is missing is null.

    The first image only, unless ``all_images``.
    """
    root = tree(html or "")
    out: dict = dict.fromkeys(DOCUMENT.fieldNames())
    out["fichier"] = re.split(r"[\\/]", path)[-1]
    issue = root.find("span", "style32")
    if issue and (m := re.search(r"\d+", issue.text())):
        out["numero"] = m.group()
    title = root.find("title")
    if title and (m := re.search(r"(\d{4})/(\d{1,2})/(\d{1,2})", title.text())):
        out["date"] = pd.to_datetime("-".join(m.groups()), errors="coerce").to_pydatetime()
        if pd.isna(out["date"]):
            out["date"] = None
    heads = [p for p in root.find_all("p", "style96") if p.find("span", "style42") and p.find("span", "style17")]
    if heads:
        out["rubrique"], out["titre"] = heads[0].find("span", "style42").text(), heads[0].find("span", "style17").text()
    body = root.find("td", "FWExtra2")
    if body:
        parts = [p.text(" ") for p in body.find_all("p") if p not in heads and "style93" not in p.attrs.get("class", "").split()]
        out["texte"] = "\n".join(p for p in parts if p)
    images = []
    for div in root.find_all("div"):
        if "text-align: center" in div.attrs.get("style", ""):
            img, caption = div.find("img"), div.find("span", "style21")
            if img is not None:
                images.append({"url": (img.attrs.get("src") or "").strip() or None, "legende": caption.text() if caption else None})
            if not all_images:
                break
    out["images"] = images
    for field, label in (("auteur", r"Rédacteur"), ("contact", r"Pour en savoir plus, contacts")):
        mark = next((s for s in root.find_all("span", "style28") if re.search(label, s.text(" "), re.I)), None)
        row = mark.up("tr") if mark else None
        cells = [c for c in row.children if isinstance(c, Element) and c.name == "td"] if row else []
        cell = cells[1].find("p", "style44") if len(cells) > 1 else None
        if cell:
            out[field] = cell.text(" ")
    return out


def page(html: str, path: str) -> dict:
    """A generic page: title, text of its article (else its body's paragraphs), all images."""
    root = tree(html or "")
    out: dict = dict.fromkeys(DOCUMENT.fieldNames())
    out["fichier"] = re.split(r"[\\/]", path)[-1]
    title = root.find("title")
    out["titre"] = title.text() if title else None
    body = root.find("article") or root.find("body") or root
    parts = [p.text(" ") for p in body.find_all("p")] or [body.text(" ")]
    out["texte"] = "\n".join(p for p in parts if p)
    out["images"] = [{"url": i.attrs.get("src"), "legende": i.attrs.get("alt") or None} for i in body.find_all("img")]
    return out


def extract(files: DataFrame, html: str = "html", path: str = "path", parser: Callable[[str, str], dict] = bulletin) -> DataFrame:
    """One document per row of (path, html), in the canonical schema. ``parser`` is any function of (html, path) to a dictionary of its fields."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parser(h, p) for h, p in zip(b["html"], b["path"])], columns=DOCUMENT.fieldNames()).astype({"date": "datetime64[us]"})

    return files.select(F.col(path).alias("path"), F.col(html).alias("html")).mapInPandas(rows, DOCUMENT)


def read_folder(spark: SparkSession, folder: str, limit: int | None = None, glob: str = "*.htm", parser: Callable[[str, str], dict] = bulletin) -> DataFrame:
    """Documents of the files of a folder, not of its subfolders; ``limit`` takes the first by path, 0 and None take all."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    files = files.select("path", F.decode("content", "UTF-8").alias("html"))
    if limit:
        files = files.orderBy("path").limit(limit)
    return extract(files, parser=parser)


def read_file(spark: SparkSession, path: str, parser: Callable[[str, str], dict] = bulletin) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
    return extract(files, parser=parser)

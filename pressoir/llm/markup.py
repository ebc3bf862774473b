"""Problem 5: markup residue, by a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hash_sample, spread

#: Labels of blocks: plain text, and text, heading, list entry, code, formula and wrapper that carry markup.
LABELS = ["nu", "texte", "titre", "liste", "code", "formule", "balise"]
#: Pages of the collection, taken by hash, whose clean lines labelled pages are made of, the longest of them in characters, lines taken, and pages made; the bounds of the sample.
SOURCE_PAGES, SOURCE_CHARS, SAMPLE_LINES, SAMPLE_PAGES = 400, 20_000, 1_500, 700

_TAGS = r"(?:a|abbr|article|aside|b|big|blockquote|body|br|center|cite|code|dd|del|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|li|link|main|math|meta|nav|nowiki|ol|option|p|pre|q|ref|s|script|section|select|small|span|strike|strong|style|sub|sup|syntaxhighlight|table|tbody|td|th|thead|title|tr|tt|u|ul|var)"
# Syntax, each by the pattern that shows it.
SYNTAX: dict[str, re.Pattern] = {
    k: re.compile(v, re.I if k in ("tag", "entity", "open", "close", "block", "item", "head") else 0)
    for k, v in {
        "tag": rf"</?{_TAGS}(?:\s[^<>]*)?/?(?:>|$)|<!--",
        "entity": r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8}\d{0,2});",
        "bold": r"\*\*\S",
        "under": r"(?<!\w)__\S[^_]*__(?!\w)",
        "strike": r"~~\S[^~]*~~",
        "star": r"(?<![*\w])\*[^\s*][^*\n]*\*(?![*\w])|(?<!\w)_[^\s_][^_\n]*_(?!\w)",
        "link": r"!?\[[^\]\n]*\]\([^)\s]*|\]\[\d+\]|^\s*\[\d+\]:\s+\S|!\[",
        "tick": r"`[^`\s][^`]*`",
        "hash": r"^\s{0,3}#{1,6}\s+\S",
        "bullet": r"^\s*[*+]+\s+\S|^\s*[-*+] \[[ xX]\] ",
        "fence": r"^\s*(?:```|~~~)",
        "rule": r"^\s*(?:=|-){3,}\s*$",
        "quotes": r"'''?[^'\s].*?''|^'''",
        "wlink": r"\[\[[^\]\n]+|\[https?://\S+\s[^\]\n]*\]",
        "brace": r"\{\{[^{}\n]*",
        "whead": r"^\s*={1,6}[^=\n]+={1,6}\s*$",
        "windent": r"^[:;]+\s*\S|^\*+\S|^#+[^\s#\d!]\S*\s",
        "wtable": r"^\{\||^\|[-}]|^\|.*\|\s*$",
        "tex": r"\\[a-zA-Z]{2,}\*?\s*(?:\{|\[)|\{\\[a-z]+\s|\\(?:item|og|fg|par|noindent|times|cdot|frac|ldots|newline|centering|hline|maketitle|LaTeX|alpha|beta|lambda|pi|sqrt|le|ge|approx|pm|mu)\b|\\\\\s*$|\\[%&_#]",
        "accent": r"\\[`'^\"~=.](?:\{\\?[a-zA-Z]\}|\\?[a-zA-Z])|\\[cHvuk]\{[a-zA-Z]\}",
        "math": r"\$\$|\$[^$\n]*[\\^_={}][^$\n]*\$|\\\(|\\\[",
        "env": r"\\(?:begin|end)\s*\{",
    }.items()
}
#: Signs that may be plain: a line with one of these needs its neighbours.
SIGNS: dict[str, re.Pattern] = {
    k: re.compile(v)
    for k, v in {
        "path": r"\b[A-Z]:\\\w|\\\w+\\\w+",
        "mail": r"<[^<>\s]+@[^<>\s]+>",
        "less": r"\w\s*<\s*\w?.*\d|&&",
        "index": r"^\s*\d+[.)] \S",
        "dash": r"^\s*[–—•-] \S",
        "indent": r"^(?:\s{2,}|\t)\S",
        "calls": r"\w\(.*\)|^\s*(?:if|for|while|def|return)\b.*[:;{]",
        "equals": r"\w\s*=\s*\w",
        "dollar": r"\$",
        "amp": r"\w&\w",
        "bracket": r"\[[^\]]*\]",
        "sharp": r"\w#|#\d",
        "aster": r"\*",
        "score": r"_",
        "caret": r"\^|`|~",
    }.items()
}
NAMES = ["bias", *SYNTAX, *SIGNS, "open", "close", "block", "item", "head", "in_pre", "in_fence", "in_env", "in_list", "in_div", "blank_text", "short", "dot", "before_rule", "after_rule", "alone", "any"]
INDEX = {n: i for i, n in enumerate(NAMES)}
#: A character that each syntax or sign needs; lines without it are not searched for it.
TRIGGER = {
    "tag": "<", "entity": "&", "bold": "*", "under": "_", "strike": "~", "star": "*_", "link": "[", "tick": "`", "hash": "#", "bullet": "*+[", "fence": "`~", "rule": "=-", "quotes": "'", "wlink": "[", "brace": "{", "whead": "=", "windent": ":;*#", "wtable": "|",
    "tex": "\\", "accent": "\\", "math": "$\\", "env": "\\", "path": "\\", "mail": "@", "less": "<&", "index": ".)", "dash": "–—•-", "indent": " \t", "calls": "(:;{", "equals": "=", "dollar": "$", "amp": "&", "bracket": "[", "sharp": "#", "aster": "*", "score": "_", "caret": "^`~",
}
_ALL = [(INDEX[n], p, TRIGGER[n]) for n, p in (SYNTAX | SIGNS).items()]
#: A text without any of these characters, for the JVM, shows no syntax at all.
MAY_MARK = r"[<>&*_`#\[\]{}\\$~=|+^]|''|(?m:^[:;-])"


def blocks(text: str) -> list[str]:
    """The leaf blocks of a page: its non-blank lines."""
    return [x for x in text.split("\n") if x.strip()]


def describe(lines: list[str]) -> np.ndarray:
    """A row of features for each block: its own syntax and signs, the tags and environments it stands in."""
    out = np.zeros((len(lines), len(NAMES)))
    pre = fence = env = 0
    lists = divs = 0
    for k, line in enumerate(lines):
        row = out[k]
        row[INDEX["bias"]] = 1
        for i, p, needs in _ALL:
            for c in needs:
                if c in line:
                    if p.search(line):
                        row[i] = 1
                    break
        low = line.lower()
        row[INDEX["in_pre"]], row[INDEX["in_fence"]], row[INDEX["in_env"]], row[INDEX["in_list"]], row[INDEX["in_div"]] = pre > 0, fence, env > 0, lists > 0, divs > 0
        if row[INDEX["tag"]]:
            row[INDEX["open"]] = re.match(r"\s*<[a-z]", low) is not None
            row[INDEX["close"]] = re.search(r"</[a-z0-9]+>\s*$", low) is not None
            row[INDEX["block"]] = re.match(r"\s*</?(?:p|div|td|tr|table|ul|ol|nav|br)\b", low) is not None
            row[INDEX["item"]] = re.match(r"\s*<li\b", low) is not None
            row[INDEX["head"]] = re.match(r"\s*<h\d\b", low) is not None
            row[INDEX["blank_text"]] = not re.sub(r"<[^<>]*>?", "", line).strip()
            if "<pre" in low or "<syntaxhighlight" in low:
                pre += 1
            if "</pre" in low or "</syntaxhighlight" in low:
                pre = 0
            lists = max(0, lists + len(re.findall(r"<(?:ul|ol)\b", low)) - len(re.findall(r"</(?:ul|ol)\b", low)))
            divs = max(0, divs + low.count("<div") - low.count("</div"))
        if row[INDEX["fence"]]:
            fence = 1 - fence
        if row[INDEX["env"]]:
            env = max(0, env + len(re.findall(r"\\begin\s*\{(?:verbatim|lstlisting|equation|align)", line)) - len(re.findall(r"\\end\s*\{(?:verbatim|lstlisting|equation|align)", line)))
        row[INDEX["short"]] = len(line) < 70
        row[INDEX["dot"]] = line.rstrip()[-1:] in ".!?;:»"
        row[INDEX["before_rule"]] = k + 1 < len(lines) and SYNTAX["rule"].match(lines[k + 1]) is not None and abs(len(lines[k + 1]) - len(line)) <= 2
        row[INDEX["after_rule"]] = k > 0 and out[k - 1, INDEX["before_rule"]]
        row[INDEX["alone"]] = len(lines) == 1
        row[INDEX["any"]] = row[1 : 1 + len(SYNTAX)].any()
    return out


class Field:
    """A linear-chain conditional random field with dense features."""

    def __init__(self, features: int, labels: int):
        self.w = np.zeros((features, labels))
        self.t = np.zeros((labels, labels))

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w

    @staticmethod
    def _sum(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of labels y, by forward and backward sums."""
        s = self._scores(x)
        n, k = s.shape
        fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
        fwd[0] = s[0]
        for i in range(1, n):
            fwd[i] = s[i] + self._sum(fwd[i - 1][:, None] + self.t, 0)
        for i in range(n - 2, -1, -1):
            bwd[i] = self._sum(self.t + s[i + 1] + bwd[i + 1], 1)
        z = self._sum(fwd[-1], 0)
        node = np.exp(fwd + bwd - z)
        target = np.zeros((n, k))
        target[np.arange(n), y] = 1
        gw = x.T @ (target - node)
        gt = np.zeros((k, k))
        for i in range(1, n):
            gt -= np.exp(fwd[i - 1][:, None] + self.t + s[i] + bwd[i] - z)
            gt[y[i - 1], y[i]] += 1
        return gw, gt

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Stochastic ascent with AdaGrad steps; the order is fixed, so the model is the same for the same pages."""
        rng = np.random.default_rng(11)
        aw, at = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        for _ in range(epochs):
            for i in rng.permutation(len(pages)):
                gw, gt = self.gradient(*pages[i])
                gw -= decay * self.w
                aw += gw * gw
                at += gt * gt
                self.w += rate * gw / np.sqrt(aw)
                self.t += rate * gt / np.sqrt(at)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels, by Viterbi."""
        s = self._scores(x)
        n, k = s.shape
        if not n:
            return np.zeros(0, int)
        best, back = s[0], np.zeros((n, k), int)
        for i in range(1, n):
            a = best[:, None] + self.t
            back[i] = a.argmax(0)
            best = a.max(0) + s[i]
        out = np.zeros(n, int)
        out[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


_ENTITY = {"é": "&eacute;", "è": "&egrave;", "à": "&agrave;", "ê": "&ecirc;", "«": "&laquo;", "»": "&raquo;", "ô": "&ocirc;", "’": "&rsquo;"}
_ACCENT = {"é": "\\'e", "è": "\\`e", "à": "\\`a", "ê": "\\^e", "ô": "\\^o", "ç": "\\c{c}"}


def labelled_pages(lines: list[str], count: int = SAMPLE_PAGES, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Labelled pages: clean lines of the collection set in HTML, Markdown, wiki or LaTeX markup, or in none.

    Plain signs of many kinds (comparisons, paths, addresses, prices, program lines, bracketed remarks) stand among them without markup.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    lines = lines or ["Une phrase simple de l'article, sans rien de plus.", "Un titre court"]
    nu, texte, titre, liste, code, formule, balise = range(7)

    def words(least: int = 1, most: int = 3) -> str:
        ws = pick(lines).split()
        n = int(rng.integers(least, most + 1))
        i = int(rng.integers(max(1, len(ws) - n)))
        return " ".join(ws[i : i + n])

    def name() -> str:
        return re.sub(r"\W+", "", words(1, 1)) or "x"

    def plain_sign() -> str:
        """A line with signs in their plain sense: comparisons, paths, addresses, amounts, brackets, footnote marks, names with signs, entries and program lines."""
        a, b, n = words(), words(), int(rng.integers(1, 99))
        sign = pick(["< ", "> ", "<= ", "& ", "# ", "* ", "^ ", "~ ", "` ", "_ ", "= ", "+ ", "$ ", "| ", "\\ ", "[...] ", "[sic] ", f"[{n}] ", f"#{n} ", f"{n} $ ", f"< {n} ", f"> 0,{n} ", f"x_{n} ", f"{name()[:1]}# ", f"{name()[:1]}&{name()[:1]} ", f"<{name()}@{name()}.test> ", f"D:\\{name()}\\{name()} ", f"/{name()}/{name()}.txt ", f"{name()}_{n}.txt ", f"{name()} = {n} * {name()} ", f"-- {b} "])
        return pick([
            f"{a} {sign}{b}.", f"{pick(lines)} {sign}", f"{a} {sign}{b} {sign}{words()}.", f"{a} ({sign.strip()}) {b}",
            f"    {name()} = {name()}({n})", f"    while {name()} > {n}:", f"for ({name()} = 0; {name()} < {n}; {name()}++) {{ {name()}[i] = {n}; }}", f"        {name()}({name()}, {n})", f"– {a} ({n} %)", f"• {a}", f"{n}. {words(3, 6)}", f"{n}) {a}", f"{a} | {b}", f"{a} > {b} > {words()}", f"│   ├── {a}", f"└── {a}", f"- {a} -", f"{name()[:1]} = {n} × {name()[:1]}²",
        ])

    def inline(kind: str, t: str) -> str:
        ws = t.split(" ")
        i = int(rng.integers(len(ws)))
        j = min(len(ws), i + 1 + int(chance(0.4)))
        w = " ".join(ws[i:j])
        new = {
            "html": [f"<b>{w}</b>", f"<strong>{w}</strong>", f"<em>{w}</em>", f'<a href="http://{name()}.test/{name()}">{w}</a>', f'<span class="x">{w}</span>', f"<FONT color=red>{w}</FONT>", f"<I>{w}</I>"],
            "md": [f"**{w}**", f"__{w}__", f"__{w}__", f"*{w}*", f"***{w}***", f"~~{w}~~", f"[{w}](http://{name()}.test)", f"![{w}](http://{name()}.test/i.png)", f"[{w}][{int(rng.integers(9))}]", f"`{w}`"],
            "wiki": [f"'''{w}'''", f"''{w}''", f"[[{w}]]", f"[[{name()}|{w}]]", f"{{{{lang|en|{w}}}}}", f"[http://{name()}.test {w}]", f'{w}<ref name="{name()}">{words()}</ref>'],
            "tex": [f"{ws[i]}$_{int(rng.integers(9))}$", f"\\textbf{{{w}}}", f"\\emph{{{w}}}", f"{{\\it {w}}}", f"{w}~\\cite{{{name()}}}", f"{w}\\footnote{{{words()}}}", f"\\href{{http://{name()}.test}}{{{w}}}", f"\\og {w}\\fg{{}}", f"{w} \\%"],
        }[kind]
        return " ".join([*ws[:i], pick(new), *ws[j:]])

    def spelled(kind: str, t: str) -> str:
        table = _ENTITY if kind == "html" else _ACCENT
        how = int(rng.integers(3))
        return "".join((table[c] if kind == "tex" or how == 0 else f"&#{ord(c)};" if how == 1 else f"&#x{ord(c):X};") if c in table else c for c in t)

    out = []
    for number in range(count):
        kind = ["nu", "html", "md", "wiki", "tex", "html", "nu"][number % 7]
        page: list[tuple[str, int]] = []
        light = chance(0.5)  # a page with one mark only
        for _ in range(int(rng.integers(3, 11))):
            t = pick(lines)
            short = words(3, 7)
            if chance(0.3):
                page.append((plain_sign(), nu))
            if kind == "nu" or light:
                page.append((t if chance(0.7) else short, nu))
                continue
            what = pick(["text", "text", "text", "head", "list", "code", "formula", "frame"])
            n = int(rng.integers(2, 5))
            if what == "text":
                t2 = spelled(kind, t) if kind in ("html", "tex") and chance(0.4) else t
                t2 = inline(kind, t2) if chance(0.7) else t2
                if kind == "html" and chance(0.7):
                    t2 = pick(["<p>", "<P>", '<p align="justify">', ""]) + t2 + pick(["</p>", "</P>", "<br>", "<BR/>", ""])
                page.append((t2, texte if t2 != t else nu))
            elif what == "head":
                if kind == "md" and chance(0.4):
                    page += [(short, titre), (pick("=-") * len(short), titre)]
                else:
                    d = int(rng.integers(1, 4))
                    page.append(({"html": f"<h{d}>{short}</h{d}>", "md": "#" * d + " " + short + pick(["", " " + "#" * d]), "wiki": "=" * (d + 1) + f" {short} " + "=" * (d + 1), "tex": pick([f"\\section{{{short}}}", f"\\chapter{{{short}}}", f"\\subsection*{{{short}}}"])}[kind], titre))
            elif what == "list":
                edge = {"html": ("<ul>", "</ul>"), "tex": ("\\begin{itemize}", "\\end{itemize}")}.get(kind)
                mark = {"html": "<li>", "md": pick(["* ", "+ ", "- [ ] "]), "wiki": pick(["* ", "** ", "*"]), "tex": "\\item "}[kind]
                page += ([(edge[0], balise)] if edge else []) + [(mark + words(2, 3) + ("</li>" if kind == "html" and chance(0.7) else ""), liste) for _ in range(n)] + ([(edge[1], balise)] if edge else [])
            elif what == "code":
                edge = {"html": ("<pre><code>", "</code></pre>"), "md": pick([("```", "```"), ("```python", "```"), ("~~~", "~~~")]), "wiki": ('<syntaxhighlight lang="python">', "</syntaxhighlight>"), "tex": ("\\begin{verbatim}", "\\end{verbatim}")}[kind]
                body = [f"{name()} = lire({n})", f"if {name()} {'&lt;' if kind == 'html' else '<'} {n}:", f"    {name()}({name()})"]
                page += [(edge[0], code), *((b, code) for b in body), (edge[1], code)]
            elif what == "formula":
                page.append(({"html": f"<i>{name()}</i> = k &times; I<sup>2</sup>", "md": pick(["$$ F = k \\times I^2 $$", "$F = k I^2$"]), "wiki": "<math>F = k \\times I^2</math>", "tex": pick(["$$ F = k \\cdot I^2 $$", "\\[ F = \\frac{a}{b} \\]", "$Q = k \\times r^2$"])}[kind], formule))
            elif kind == "html":
                page.append((pick([f'<div class="nav">{short}</div>', f"<td>{short}</td>", f'<li><a href="/3">{short}</a></li>', '<div id="entete">', "</div>", "<!-- fin -->"]), balise))
            else:
                page.append((short, nu))
        if light and kind != "nu":
            i = int(rng.integers(len(page)))
            t = pick(lines) if chance(0.7) else short
            marked = spelled(kind, t) if kind in ("html", "tex") and chance(0.4) else t
            if marked == t or chance(0.3):  # spelled in plain letters or on top of it
                marked = inline(kind, marked) if chance(0.8) else marked + pick(["&nbsp;", "&rsquo;", "&#160;", "&hellip;"])
            page.insert(i, (marked, texte))
        out.append(([t for t, _ in page], [y for _, y in page]))
    return out


def train(lines: list[str]) -> Field:
    pages = [(describe(t), np.array(y)) for t, y in labelled_pages(lines)]
    # titles are pages of one block
    pages += [(describe(t[i : i + 1]), np.array(y[i : i + 1])) for t, y in labelled_pages(lines, SAMPLE_PAGES // 3, 6) for i in range(min(2, len(t))) if y[i] in (0, 1, 2)]
    return Field(len(NAMES), len(LABELS)).fit(pages)


_clean_line = re.compile(r"^[^\W_][\w ,;:.!?'’«»()%-]{11,399}$")


def model(pages: DataFrame, text: str = "texte") -> Field:
    """The field, fitted on the driver on labelled pages made of at most SAMPLE_LINES clean lines of SOURCE_PAGES pages taken by hash."""
    able = pages.where(F.length(text) <= SOURCE_CHARS)
    found: list[str] = []
    for r in hash_sample(able, text, SOURCE_PAGES).toLocalIterator():
        found += [x for x in r[0].split("\n") if _clean_line.match(x)]
    return train(sorted(dict.fromkeys(found), key=lambda x: zlib.crc32(x.encode()))[:SAMPLE_LINES])


_OPENS = [
    ("titre", re.compile(r"\s*(?:<h[1-6]\b|#{1,6}\s|={2,6}[^=\n]+={2,6}\s*$|\\(?:section|subsection|subsubsection|chapter|title)\*?\{)", re.I)),
    ("liste", re.compile(r"\s*(?:<li\b(?!>\s*<a href=\"?/)|[*+]+\s+\S|[-*+] \[[ xX]\] |\*+[^\s*]|\\item\b)(?!\*)", re.I)),
]


def labels_of(text: str | None, field: Field) -> list[tuple[str, int]]:
    """(block, label) of the whole text, as the field decodes it. The syntax that opens a block which the field takes for markup settles its kind."""
    lines = blocks(text) if text else []
    if not lines:
        return []
    x = describe(lines)
    out = []
    for line, y in zip(lines, map(int, field.decode(x))):
        if y and LABELS[y] != "code":
            y = next((LABELS.index(kind) for kind, p in _OPENS if p.match(line)), y)
        out.append((line, y))
    return out


_may_mark = re.compile(MAY_MARK)


def has_markup(text: str | None, field: Field) -> bool:
    """Whether the field takes any block of the text for markup."""
    lines = blocks(text) if text and _may_mark.search(text) else []
    return bool(lines) and bool(field.decode(describe(lines)).any())


_texaccent = re.compile(r"\\([`'^\"~=.])(?:\{\\?([a-zA-Z])\}|\\?([a-zA-Z]))|\\c\{([a-zA-Z])\}")
_MARK = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇"}


def bare(line: str) -> str:
    """The text of a block without inline markup."""
    line = re.sub(r"<!--.*?(?:-->|$)", "", line)
    line = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", line, flags=re.I)
    line = re.sub(rf"</?{_TAGS}(?:\s[^<>]*)?/?(?:>|$)", "", line, flags=re.I)
    line = html.unescape(line)
    line = _texaccent.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3] or m[4]) + (_MARK[m[1]] if m[1] else "̧")), line)
    line = re.sub(r"\\og\b\s*", "« ", line)
    line = re.sub(r"\s*\\fg(?:\{\}|\b)", " »", line)
    line = re.sub(r"~?\\(?:cite|footnote|label|ref)\{[^{}]*\}", "", line)
    line = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", line)
    line = re.sub(r"\\(?:textbf|textit|emph|underline|texttt|textsc|section|subsection|subsubsection|chapter|title|paragraph)\*?\{([^{}]*)\}", r"\1", line)
    line = re.sub(r"\{\\[a-z]+\s+([^{}]*)\}", r"\1", line)
    line = re.sub(r"\\([%&_#$])", r"\1", line)
    line = re.sub(r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", line)
    line = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", line)
    line = re.sub(r"\[https?://\S+\s([^\]]*)\]", r"\1", line)
    line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
    line = re.sub(r"\[([^\]]*)\]\[\d+\]", r"\1", line)
    line = re.sub(r"'''?", "", line)
    line = re.sub(r"(\*{1,3})(\S(?:[^*\n]*\S)?)\1", r"\2", line)
    line = re.sub(r"(?<!\w)(__?)(\S(?:[^_\n]*\S)?)\1(?!\w)", r"\2", line)
    line = re.sub(r"~~([^~]*)~~", r"\1", line)
    return re.sub(r"`([^`]*)`", r"\1", line).strip()


def clean(text: str | None, field: Field) -> str | None:
    """The text without markup: headings as '# ', list entries as '- ', code fenced, formulas between dollar signs.

    Null stays null. Plain blocks are kept as they are, blank lines between blocks are not.
    """
    if text is None:
        return None
    out: list[str] = []
    code = False
    for line, y in labels_of(text, field):
        name = LABELS[y]
        if name == "code":
            edge = SYNTAX["fence"].match(line) or SYNTAX["env"].match(line) or re.match(r"\s*</?(?:pre|code|syntaxhighlight)\b[^<>]*>\s*(?:</?code>)?\s*$|\s*</code></pre>\s*$", line, re.I)
            if not code:
                out.append("```")
                code = True
            if not edge:
                out.append(html.unescape(re.sub(r"</?(?:pre|code|syntaxhighlight)\b[^<>]*>", "", line, flags=re.I)))
            elif not re.match(r"\s*(?:```\w|<pre|<syntax|\\begin)", line, re.I) and len(out) > 1 and out[-1] != "```":
                out.append("```")
                code = False
            continue
        if code:
            out.append("```")
            code = False
        if name == "nu":
            out.append(line)
        elif name == "titre":
            if not SYNTAX["rule"].match(line):
                out.append("# " + bare(re.sub(r"^\s*[#=]+\s*|\s*[#=]+\s*$", "", line)))
        elif name == "liste":
            out.append("- " + bare(re.sub(r"^\s*(?:[-*+:;#]+(?: \[[ xX]\])?\s*|\\item\s*)", "", line)))
        elif name == "formule":
            inner = re.sub(r"^\s*(?:\$\$?|\\\[|\\\()\s*|\s*(?:\$\$?|\\\]|\\\))\s*$|</?math>", "", line)
            inner = re.sub(r"<sup>(.*?)</sup>", r"^\1", inner)
            inner = inner if "\\" in inner else bare(inner)
            out.append(f"${inner.strip()}$")
        elif name == "balise":
            if (kept := bare(line)) and not SYNTAX["env"].search(line):
                out.append(kept)
        elif kept := bare(line):
            out.append(kept)
    if code:
        out.append("```")
    return "\n".join(out)


def marked_fields(pages: DataFrame, fields: list[str], key: str = "fichier", text: str = "texte") -> DataFrame:
    """(key, champ) of the fields that hold markup, repeated rows once. Null and empty fields hold none; no shuffle but for distinct rows."""
    shared = pages.sparkSession.sparkContext.broadcast(model(pages, text))

    @F.pandas_udf("boolean")
    def marked(col: pd.Series) -> pd.Series:
        return col.map(lambda t: has_markup(t, shared.value)).astype(bool)

    pages = spread(pages.select(key, *fields))
    parts = [pages.where(F.col(f).isNotNull()).select(F.col(key).alias(key), F.lit(f).alias("champ"), F.col(f).alias("contenu")) for f in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where(F.col("contenu").rlike(MAY_MARK)).where(marked("contenu")).select(key, "champ").distinct()


def clean_fields(pages: DataFrame, fields: list[str], key: str = "fichier", text: str = "texte") -> DataFrame:
    """(key, champ, contenu, propre) of every field, with its clean text."""
    shared = pages.sparkSession.sparkContext.broadcast(model(pages, text))

    @F.pandas_udf("string")
    def tidy(col: pd.Series) -> pd.Series:
        return col.map(lambda t: clean(t, shared.value))

    pages = spread(pages.select(key, *fields))
    parts = [pages.select(F.col(key).alias(key), F.lit(f).alias("champ"), F.col(f).alias("contenu")) for f in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.distinct().withColumn("propre", tidy("contenu"))

"""Problem 10: keyword-stuffed and link-list pages, from recurrence gaps and positional autocorrelation."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Function words of French, English, German and Spanish.
FUNCTION_WORDS = frozenset(
    """
    a à ai ainsi alors après au aucun aucune aussi autre aux avait avant avec c ce cela celui ces cet cette comme comment contre d dans de depuis des deux donc
    dont du elle elles en encore entre est et été être eu fait faut il ils j je jusqu l la le les leur leurs lui m mais même moins n ne ni nos notre nous on ont or ou où par
    pas peu plus pour puis qu quand que quel quelle qui reste s sa sans se selon sera ses si son sont sous sur t te tes toujours tous tout toute très trop tu un une va vers voir vos votre vous y
    about after all although an and any are as at be been before but by can could did do for from had has have he his how i if in into is it its no not of that the their they this to was were what when
    which while who will with within would you your
    aber als am an auch auf aus bei bis das dass dem den der des die dieser durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch oder ob seit sich sie sind so über um und unter
    vom von vor war was wenn wer werden wie wird wurde zu zum zur zwischen
    al ante aún como con cuando del desde después e el ella entre era es esta este esto fue ha han hasta lo los más me mi muy no o para pero por porque próximo que se sea según ser si sin sobre son su sus también
    te todavía un una y ya
    """.split()
)
LINK = re.compile(r"https?://\S+|www\.\S+|\]\([^)\s]*\)")
CUT = re.compile(r"(?<=[.!?…])\s+|\n+")
#: A link is a term of its own; a word is a run of letters and digits.
TERM = re.compile(r"https?://\S+|www\.\S+|\]\([^)\s]*\)|[^\W_]+")
LINKED = ("http", "www.", "](")
#: Gaps, in terms: most of a short gap, and share of short gaps from which a term is dense; mean gap and relative spread of a recurrent one at most; of an even one. Least occurrences of a term, and of an even one.
SHORT, DENSE, RECURRENT, EVEN, LEAST_TIMES, EVEN_TIMES = 6, 0.6, ((9, 1.5), (12, 1.2)), (24, 0.35), 4, 6
#: Share of terms repeated at one lag from which a text is periodic; share of a segment's content terms that recur, from which it is stuffed, and the same of all its words for dense terms;
#: shares of function words below which it is a list, and from which it is a sentence or verse, which may be said again; share of characters in links from which a segment is a link.
PERIODIC, REGULAR, THICK, LIST, SENTENCE, LINKS = 0.8, 0.25, 0.2, 0.13, 0.28, 0.25


#: Occurrences whose pairs are counted together; a bound of memory only.
BLOCK = 4_096


def agreement(terms: np.ndarray) -> np.ndarray:
    """For each lag from 0 to half the length, how many positions hold the same term as the position so many on; negative terms are none.

    Pairs of a term are counted one by one where it is rare, by its spectrum where it is frequent: exact either way, and never quadratic in the length.
    """
    n = len(terms)
    half = n // 2
    out = np.zeros(half + 1, "int64")
    order = np.argsort(terms, kind="stable")
    order = order[np.searchsorted(terms[order], 0) :]
    frequent = max(64, int((n * math.log2(n + 2)) ** 0.5))
    held = terms[order]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, "int64")
    times = np.diff(np.append(starts, len(held)))
    many = times > frequent
    for a, k in zip(starts[many], times[many]):
        mark = np.zeros(1 << (n + half).bit_length())
        mark[order[a : a + k]] = 1
        out += np.rint(np.fft.irfft(np.abs(np.fft.rfft(mark)) ** 2, len(mark))[: half + 1]).astype("int64")
    few = ~many & (times > 1)
    place, counts = order[np.repeat(few, times)], times[few]
    firsts = np.repeat(np.cumsum(counts) - counts, counts)
    rank = np.arange(len(place)) - firsts  # how many occurrences of the term stand before
    for a in range(0, len(place), BLOCK):  # pairs of so many occurrences at a time
        r = rank[a : a + BLOCK]
        ends = np.cumsum(r)
        within = np.arange(int(ends[-1])) - np.repeat(ends - r, r)
        lags = np.repeat(place[a : a + BLOCK], r) - place[np.repeat(firsts[a : a + BLOCK], r) + within]
        out += np.bincount(lags[lags <= half], minlength=half + 1)
    return out


def autocorrelation(terms: np.ndarray) -> tuple[float, int]:
    """The peak of the positional autocorrelation, and its lag: the largest share of positions with a term that hold the same one so many
    positions on, over all lags that the text holds at least twice (four times for the lag); (0.0, 0) where there is none."""
    n = len(terms)
    if n < 2:
        return 0.0, 0
    held = np.cumsum(terms >= 0)
    lags = np.arange(1, n // 2 + 1)
    share = agreement(terms)[1:] / np.maximum(1, held[n - lags - 1])
    often = share[: n // 4]
    return float(share.max()), int(often.argmax()) + 1 if len(often) else 0


def regular(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Which positions hold a dense term, which one that recurs at longer gaps or one period of the text before or after, and the autocorrelation's peak.

    Gaps are those between neighbouring occurrences of one term, over the whole text; negative terms are none. Term 0, the links, recurs from two occurrences on.
    """
    n = len(terms)
    dense, again = np.zeros(n, bool), np.zeros(n, bool)
    peak, lag = autocorrelation(terms)
    if lag:
        same = (terms[:-lag] == terms[lag:]) & (terms[:-lag] >= 0)
        if same.sum() >= PERIODIC * max(1, (terms[:-lag] >= 0).sum()):
            again[:-lag] |= same
            again[lag:] |= same
    order = np.argsort(terms, kind="stable")
    order = order[np.searchsorted(terms[order], 0) :]
    if not len(order):
        return dense, again, peak
    held = terms[order]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    times = np.diff(np.append(starts, len(held)))
    gaps = np.append(0, np.diff(order)).astype("float64")
    gaps[starts] = 0.0
    count = np.maximum(1, times - 1)
    mean = np.add.reduceat(gaps, starts) / count
    spread = np.sqrt(np.maximum(0.0, np.add.reduceat(gaps * gaps, starts) / count - mean * mean)) / np.maximum(mean, 1e-9)
    often = (times >= LEAST_TIMES) | (held[starts] == 0) & (times > 1)
    inner = np.ones(len(order), bool)
    inner[starts] = False
    short = often & (np.add.reduceat((inner & (gaps <= SHORT)).astype("int64"), starts) >= DENSE * count)
    long = (mean <= EVEN[0]) & (spread <= EVEN[1]) & (times >= EVEN_TIMES)
    for most, uneven in RECURRENT:
        long |= often & (mean <= most) & (spread <= uneven)
    dense[order[np.repeat(short, times)]] = True
    again[order[np.repeat(long | short, times)]] = True
    return dense, again, peak


#: Numbers of terms, the same for all spellings of one in upper and lower case: 0 for links, -1 for function words, -2 for figures. Kept between texts; a worker forgets them beyond so many.
MOST_KEPT = 300_000
_codes: dict[str, int] = {}


def _code(t: str) -> int:
    w = t.lower()
    got = 0 if t.startswith(LINKED) else -1 if w in FUNCTION_WORDS else -2 if w.isdigit() else len(_codes) + 1 if w == t else _codes.get(w) or _code(w)
    _codes[t] = got
    return got


def _numbered(parts: list[list[str]]) -> np.ndarray:
    if len(_codes) > MOST_KEPT:
        _codes.clear()
    get = _codes.get
    return np.array([c if (c := get(t)) is not None else _code(t) for ts in parts for t in ts], dtype="int64")


MEASURES = ("mots", "liens", "outils", "autocorrelation", "regularite", "listes", "bourrage")


def stuffing(text: str | None) -> dict[str, float]:
    """Measures of one text, read whole.

    Its terms are its words and, as one term of its own, its links. ``mots`` counts the words, ``liens`` the links, ``outils`` is the share of function words,
    ``autocorrelation`` the peak of the positional autocorrelation. ``regularite`` is the share of the text, in characters, in segments thick with dense terms, in
    segments whose content terms recur at longer gaps or at the text's own period (see ``regular``) but for sentences and verse said again, and in links that recur densely, with
    their anchors; ``listes`` the share in segments of other, distinct content words without function words; ``bourrage`` their sum.
    """
    none = dict.fromkeys(MEASURES, 0.0) | {"mots": 0, "liens": 0}
    if not text or not text.strip():
        return none
    segments = [(s, TERM.findall(s)) for s in CUT.split(text) if s and not s.isspace()]
    terms = _numbered([ts for _, ts in segments])
    dense, again, peak = regular(terms)
    sizes = np.array([len(ts) for _, ts in segments])
    ends = np.cumsum(sizes)

    def each(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[ends] - total[ends - sizes]

    chars = np.array([len(s) for s, _ in segments], dtype="float64")
    tools, linked, figures = each(terms == -1), each(terms == 0), each(terms == -2)
    thick, hot = each(dense & (terms > 0)), each(again & (terms > 0))
    words = sizes - linked
    content = np.maximum(1, words - tools - figures)
    near = lambda x: x + np.append(x[1:], 0) + np.append(0, x[:-1])  # noqa: E731, with the segments before and after
    repeats = (thick > 0) & (near(thick) >= 3) & (near(thick) >= THICK * near(words)) | (tools < SENTENCE * np.maximum(1, words)) & (hot > 0) & (hot >= REGULAR * content)
    taken = np.where(repeats, chars, 0.0)
    if linked.any():
        recurs = each(again & (terms == 0)) > 0  # the links of the text recur
        address = np.array([sum(len(t) for t in ts if t.startswith(LINKED)) if k else 0 for k, (_, ts) in zip(linked, segments)], dtype="float64")
        cited = (words > 9) & (tools >= 0.2 * words)  # a sentence that cites a link keeps its words
        taken = np.maximum(taken, np.where(recurs & (address >= LINKS * chars), np.where(cited, address, chars), 0.0))
    lists = (taken == 0) & (tools < LIST * np.maximum(1, words)) & (words > 0)
    if len(segments) < 3:
        lists &= words >= 3
    total = chars.sum()
    regularity, listed = float(taken.sum() / total), float(chars[lists].sum() / total)
    count = int(words.sum())
    return none | {"mots": count, "liens": int(linked.sum()), "outils": round(float(tools.sum()) / max(1, count), 6), "autocorrelation": round(peak, 6), "regularite": round(regularity, 6), "listes": round(listed, 6), "bourrage": round(regularity + listed, 6)}


def stuffing_column(text: Column) -> Column:
    """A struct of the measures of ``stuffing``; a null text is like an empty one."""

    @F.pandas_udf("mots long, liens long, outils double, autocorrelation double, regularite double, listes double, bourrage double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stuffing(t) for t in texts], columns=list(MEASURES))

    return measure.asNondeterministic()(text)  # else a filter on a measure has the texts measured twice


#: Shares from which a text counts as stuffed for the larger part.
LEAST_STUFFED = 0.45


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures..., spam) of every row; no shuffle but to spread a scan of few partitions.

    Null, empty and blank texts are no spam; a null key is kept; other columns are ignored.
    """
    rows = spread(docs.select(key, text)).select(F.col(key).alias(key), stuffing_column(F.col(text)).alias("m")).select(key, "m.*")
    return rows.withColumn("spam", F.col("bourrage") > LEAST_STUFFED)

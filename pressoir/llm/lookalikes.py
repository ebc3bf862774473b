"""Problem 3: visually identical text with different characters, brought to one consistent form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_margin, materialize

# Letters of other alphabets and the Latin letters they look like, most alike first.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "vn", "ο": "o", "ρ": "p", "τ": "t", "υ": "uy", "χ": "x", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "в": "b", "г": "r", "е": "e", "и": "u", "к": "k", "м": "m", "н": "hn", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "yu", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
    # Armenian
    "ա": "w", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "զ": "q",
}
#: Characters that show nothing: soft hyphen, joiners, zero-width spaces, direction marks, variation selectors.
IGNORABLES = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
#: Spaces other than the plain one and the line break.
SPACES = "\t\x0b\x0c\r\x85   -     　"
#: Hyphens other than the plain one; dashes are no hyphens.
HYPHENS = "‐‑﹣－᠆"
#: Accents as separate marks.
MARKS = "̀-ͯ᷀-᷿⃐-⃜"
#: Full-width, joined and styled forms of ordinary characters.
FORMS = "！-～￠-￦ﬀ-ﬆĲĳǄ-ǌǱ-ǳ"
STYLED = "\U0001d400-\U0001d7ff"

FOREIGN = "".join(LOOKALIKES)
_ignorable = re.compile(f"[{IGNORABLES}]")
_space = re.compile(f"[{SPACES}]")
_hyphen = re.compile(f"[{HYPHENS}]")
_form = re.compile(f"[{FORMS}{STYLED}]+")
_plain_dirt = re.compile(f"[{IGNORABLES}{SPACES}{HYPHENS}{MARKS}{FORMS}{STYLED}]")
_word = re.compile(r"[^\W\d_]+")
_foreign = re.compile(f"[{FOREIGN}]")
_elided = re.compile(f"(?<![^\\W_])[{FOREIGN}](?=['’][A-Za-zÀ-ÖØ-öø-ɏ])")
_latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")

#: The same, for the JVM. A word may hold marks and ignorables.
DIRT = f"[{IGNORABLES}{SPACES}{HYPHENS}{MARKS}{FORMS}]|[\\x{{1d400}}-\\x{{1d7ff}}]|(?<![\\p{{L}}\\p{{N}}])[{FOREIGN}](?=['’]\\p{{IsLatin}})"
WORD = f"[\\p{{L}}\\p{{M}}{IGNORABLES}]+"
#: Any letter of another alphabet, look-alike or not.
OTHER = r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}]]"
SUSPECT = f"[{IGNORABLES}{MARKS}{FORMS}]|[\\x{{1d400}}-\\x{{1d7ff}}]|\\p{{IsLatin}}[\\p{{M}}{IGNORABLES}]*{OTHER}|{OTHER}[\\p{{M}}{IGNORABLES}]*\\p{{IsLatin}}"
#: A character that ordinary French text does not hold: texts without one need no closer look.
UNUSUAL = "[^\\n -~À-ÖØ-öø-ÿœŒ’‘“”…–—€«»°²³½×±·§]"
#: Letters that alternatives of one look-alike join into a class, for the blocking key only.
CLASSES = ("vynuh", "uuuuu")


def tidy(text: str) -> str:
    """The table part: forms, marks, ignorables, spaces and hyphens made plain; letters of other
    alphabets are left, but for one that is elided before a Latin word."""
    if _elided.search(text):
        text = _elided.sub(lambda m: LOOKALIKES[m.group()][0], text)
    if not _plain_dirt.search(text):
        return text
    text = _ignorable.sub("", text)
    text = _form.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _space.sub(" ", text)
    text = _hyphen.sub("-", text)
    return unicodedata.normalize("NFC", text)


def mixed(word: str) -> bool:
    """Whether letters of another alphabet stand inside a word of Latin letters.

    One Greek letter before one or two Latin ones is a symbol (νe, ρg), no case.
    """
    if not (_foreign.search(word) and _latin.search(word)):
        return False
    foreign = [c for c in word if c in LOOKALIKES]
    return not (len(foreign) == 1 and foreign[0] == word[0] and "α" <= foreign[0] <= "ω" and len(word) <= 3)


def unknown(c: str) -> bool:
    """Whether the character is a letter of another alphabet that has no Latin look-alike."""
    return c.isalpha() and c not in LOOKALIKES and not _latin.match(c) and "LATIN" not in unicodedata.name(c, "LATIN") and c not in "µªº"


#: Stands for a letter of another alphabet without a look-alike: any letter at the cost UNKNOWN_COST, allowed once in a word of three Latin letters or more.
ANY, UNKNOWN_COST, LEAST_LATIN = "\u0000", 0.5, 3


def readings(word: str) -> list[str]:
    """Per position of the tidied word, the Latin letters it may stand for at no cost; other characters stand for themselves, but for one letter without a look-alike."""
    word = tidy(word)
    strange = sum(map(unknown, word))
    if strange == 1 and len(_latin.findall(word)) >= LEAST_LATIN:
        return [ANY if unknown(c) else LOOKALIKES.get(c, c) for c in word]
    return [LOOKALIKES.get(c, c) for c in word] if mixed(word) else list(word)


def by_table(word: str) -> str:
    """The word with each look-alike read as the letter it is most like; a letter without one stays."""
    word = tidy(word)
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c)[0] for c in word) if mixed(word) or sum(map(unknown, word)) == 1 and len(_latin.findall(word)) >= LEAST_LATIN else word)


class Trie:
    """A vocabulary with counts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def match(self, options: list[str], budget: float = 0.0) -> str | None:
        """The commonest spelling reached through the options at a cost of at most ``budget``.

        A weighted edit automaton: a letter among the options of a position costs nothing (look-alikes; ignorables are gone from the
        options), a letter without a look-alike (ANY) stands for any letter at UNKNOWN_COST, any other substitution, insertion or deletion costs 1. Cheaper spellings go first, then commoner, then smaller ones.
        """
        best: tuple[float, int, str] | None = None
        stack = [(0, self.root, 0.0, "")]
        while stack:
            i, node, cost, word = stack.pop()
            if i == len(options) and "" in node:
                found = (cost, -node[""], word)
                if best is None or found < best:
                    best = found
            free = options[i] if i < len(options) else ""
            if free == ANY:
                if cost + UNKNOWN_COST <= budget:
                    stack += [(i + 1, child, cost + UNKNOWN_COST, word + c) for c, child in node.items() if c]
                if budget < cost + 1:
                    continue
            elif budget < cost + 1:  # only free moves are left
                for c in free:
                    if c in node:
                        stack.append((i + 1, node[c], cost, word + c))
                continue
            if i < len(options):
                stack.append((i + 1, node, cost + 1, word))
            for c, child in node.items():
                if c:
                    if i < len(options):
                        stack.append((i + 1, child, cost + (c not in free), word + c))
                    stack.append((i, child, cost + 1, word + c))
        return best[2] if best else None


def fold_key(word: str) -> str:
    return word.lower().translate(str.maketrans(*CLASSES))


def patterns(word: str) -> list[str]:
    """The folded word with each of its letters left open, one at a time."""
    w = fold_key(word)
    return [w[:i] + ANY + w[i + 1 :] for i in range(len(w))]


def canonical_words(texts: DataFrame, text: str = "texte") -> DataFrame:
    """(mot, forme, voie, n): for every distinct suspect word of the texts its one consistent spelling.

    The vocabulary is the texts' own plain words with their counts. Words that can match share a
    folded key (for a word with a letter that has no look-alike, the key with this letter left open), so suspects and vocabulary meet in hash buckets of keys, each bucket
    builds the trie of its words and traverses it: at no cost first, then with a budget of one letter without a look-alike. The trie decides: a
    word it reaches takes that spelling; by the table go only words that match nothing, and a letter that has no look-alike stays then.
    voie is 'lexique' where the trie gave the spelling, 'table' where no word matched.
    Words whose spelling is already consistent are left out. n is how often the word occurs.
    """
    words = texts.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("mot"))
    counted = materialize(words.groupBy("mot").agg(F.count("*").alias("n")), "mots")

    @F.pandas_udf("string")
    def key(col: pd.Series) -> pd.Series:
        return col.map(lambda w: fold_key("".join(r[0] for r in readings(w))))

    @F.pandas_udf("array<string>")
    def opened(col: pd.Series) -> pd.Series:
        return col.map(patterns)

    suspects = materialize(counted.where(F.col("mot").rlike(UNUSUAL) & F.col("mot").rlike(SUSPECT)).select("mot", "n", key("mot").alias("cle_mot")), "mots_suspects")
    plain = counted.where(~F.col("mot").rlike(UNUSUAL) | ~F.col("mot").rlike(f"{SUSPECT}|{OTHER}")).select("mot", "n", F.translate(F.lower("mot"), *CLASSES).alias("cle_mot"))
    open_keys = suspects.where(F.col("cle_mot").contains(ANY))
    if open_keys.limit(1).count():
        plain = plain.unionByName(plain.select("mot", "n", F.explode(opened("mot")).alias("cle_mot")))
    plain = plain.join(suspects.select("cle_mot").distinct(), "cle_mot", "left_semi")
    # buckets grow with the vocabulary
    buckets = max(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counted.count() // 20_000)
    tas = F.pmod(F.xxhash64("cle_mot"), F.lit(buckets))

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in zip(right["clair"], right["n"]):
            trie.add(w, int(n))
        out = []
        for w, n in zip(left["suspect"], left["fois"]):
            options = readings(w)
            budget = UNKNOWN_COST if ANY in options else 0.0
            found = trie.match(options, budget)
            if not found and (lower := trie.match([o.lower() for o in options], budget)):  # known in lower case only: keep the case as written
                found = "".join(c.upper() if o[0].isupper() else c for c, o in zip(lower, options)) if len(lower) == len(options) else None
            forme = found or by_table(w)
            if forme != w:
                out.append((w, forme, "lexique" if found else "table", n))
        return pd.DataFrame(out, columns=["mot", "forme", "voie", "n"])

    a = suspects.select(F.col("mot").alias("suspect"), F.col("n").alias("fois"), tas.alias("tas_s"))
    b = plain.select(F.col("mot").alias("clair"), F.col("n").alias("n"), tas.alias("tas_c"))
    return a.groupBy("tas_s").cogroup(b.groupBy("tas_c")).applyInPandas(look_up, "mot string, forme string, voie string, n long")


def written_texts(articles: DataFrame, requests: DataFrame) -> DataFrame:
    """(champ, cle, pos, texte) of articles.texte and of each term of requetes.content_terms that is not null, as often as delivered."""
    a = articles.select(F.lit("texte").alias("champ"), F.col("fichier").alias("cle"), F.lit(0).alias("pos"), "texte")
    r = requests.select(F.lit("content_terms").alias("champ"), F.col("query_id").cast("string").alias("cle"), F.posexplode("content_terms").alias("pos", "texte"))
    return a.unionByName(r).where(F.col("texte").isNotNull())


def _suspect_rows(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("texte").rlike(UNUSUAL) & F.col("texte").rlike(f"{DIRT}|{SUSPECT}"))


def _with_forms(rows: DataFrame, formes: DataFrame) -> DataFrame:
    """Rows of words with their forms; a word that very many texts hold fills no task."""
    return join_margin(rows, formes, "mot", F.col("n"), formes.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0])


def dirty_texts(texts: DataFrame) -> DataFrame:
    """(champ, cle) of the texts whose consistent form differs from what is written.

    Null and empty texts are consistent. A text differs where a word has another canonical spelling, or where forms,
    spaces, hyphens, marks or ignorables stand outside words.
    """
    formes = materialize(canonical_words(texts), "formes")
    suspects = materialize(_suspect_rows(texts), "suspects")
    outside = suspects.where(F.col("texte").rlike(DIRT)).select("champ", "cle")
    rows = suspects.select("champ", "cle", F.explode(F.array_distinct(F.regexp_extract_all("texte", F.lit(WORD), F.lit(0)))).alias("mot")).where(F.col("mot").rlike(SUSPECT))
    return _with_forms(rows, formes).select("champ", "cle").unionByName(outside).distinct()


def consistent_texts(texts: DataFrame) -> DataFrame:
    """(champ, cle, pos, texte, forme): every text with its one consistent form, repeated rows once.

    Each suspect text gets the spellings of its own suspect words (as many as it holds) and is rewritten; other texts are passed through without a join.
    """
    formes = materialize(canonical_words(texts), "formes")
    row = ["champ", "cle", "pos", "ligne"]
    once = texts.withColumn("ligne", F.xxhash64("texte")).dropDuplicates(row)
    suspect = F.col("texte").rlike(UNUSUAL) & F.col("texte").rlike(f"{DIRT}|{SUSPECT}")
    once = materialize(once.withColumn("suspect", suspect), "textes")
    dirty = once.where("suspect")
    rows = dirty.select(*row, F.explode(F.array_distinct(F.regexp_extract_all("texte", F.lit(WORD), F.lit(0)))).alias("mot")).where(F.col("mot").rlike(SUSPECT))
    maps = _with_forms(rows, formes).groupBy(*row).agg(F.collect_list(F.struct("mot", "forme")).alias("formes"))

    @F.pandas_udf("string")
    def rewrite(texte: pd.Series, formes: pd.Series) -> pd.Series:
        return pd.Series([_rewrite(t, f) for t, f in zip(texte, formes)])

    same = F.lit(True)
    for c in row:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}"))
    written = dirty.alias("d").join(maps.alias("m"), same, "left").select("d.champ", "d.cle", "d.pos", "d.texte", rewrite("d.texte", "m.formes").alias("forme"))
    return once.where("not suspect").select("champ", "cle", "pos", "texte", F.col("texte").alias("forme")).unionByName(written)


_jvm_word = re.compile(f"[^\\W\\d_{IGNORABLES}](?:[^\\W\\d_]|[{MARKS}{IGNORABLES}])*|[{MARKS}{IGNORABLES}]+")


def _rewrite(text: str, formes) -> str:
    known = {x["mot"]: x["forme"] for x in formes} if formes is not None else {}

    def one(m: re.Match) -> str:
        w = m.group()
        return known.get(w) or by_table(w)

    return tidy(_jvm_word.sub(one, text)) if text else text


def matches(texts: Iterator[str]) -> list[str]:
    """The table part over plain strings, without a vocabulary."""
    return [_rewrite(t, None) for t in texts]

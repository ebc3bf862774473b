"""French stemming (the published Snowball algorithm) and the registry of normalisers."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

V = "aeiouyâàëéêèïîôûù"

# The suffixes of the published algorithm, by the rule that treats them.
S_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
S_ATION = "atrice ateur ation atrices ateurs ations".split()
S_VERB_I = "îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
S_VERB_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
S_VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    n = len(w)
    rv = n
    if len(w) >= 2 and w[0] in V and w[1] in V or w[:3] in ("par", "col", "tap"):
        rv = min(3, n)
    else:
        rv = next((i + 1 for i in range(1, n) if w[i] in V), n)
    r1 = next((i + 1 for i in range(1, n) if w[i] not in V and w[i - 1] in V), n)
    r2 = next((i + 1 for i in range(r1 + 1, n) if w[i] not in V and w[i - 1] in V), n)
    return rv, r1, r2


def _longest(w: str, suffixes: list[str], start: int = 0) -> str:
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one French word."""
    w = word.lower()
    w = re.sub(rf"(?<=[{V}])u(?=[{V}])", "U", w)
    w = re.sub(rf"(?<=[{V}])i(?=[{V}])", "I", w)
    w = re.sub(rf"(?<=[{V}])y|y(?=[{V}])", "Y", w)
    w = w.replace("qu", "qU")
    w = w.replace("ë", "He").replace("ï", "Hi")
    rv, r1, r2 = _regions(w)

    def cut(s: str, new: str = "") -> None:
        nonlocal w
        w = w[: len(w) - len(s)] + new

    def at(s: str) -> int:
        return len(w) - len(s)

    done = verb = False
    all_ = S_DELETE + S_ATION + "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
    s = _longest(w, all_)
    if s in S_DELETE and at(s) >= r2:
        cut(s)
        done = True
    elif s in S_ATION and at(s) >= r2:
        cut(s)
        if w.endswith("ic"):
            cut("ic", "" if at("ic") >= r2 else "iqU")
        done = True
    elif s in ("logie", "logies") and at(s) >= r2:
        cut(s, "log")
        done = True
    elif s in ("usion", "ution", "usions", "utions") and at(s) >= r2:
        cut(s, "u")
        done = True
    elif s in ("ence", "ences") and at(s) >= r2:
        cut(s, "ent")
        done = True
    elif s in ("ement", "ements") and at(s) >= rv:
        cut(s)
        if w.endswith("iv") and at("iv") >= r2:
            cut("iv")
            if w.endswith("at") and at("at") >= r2:
                cut("at")
        elif w.endswith("eus"):
            if at("eus") >= r2:
                cut("eus")
            elif at("eus") >= r1:
                cut("eus", "eux")
        elif w.endswith(("abl", "iqU")) and at("abl") >= r2:
            cut("abl")
        elif w.endswith(("ièr", "Ièr")) and at("ièr") >= rv:
            cut("ièr", "i")
        done = True
    elif s in ("ité", "ités") and at(s) >= r2:
        cut(s)
        if w.endswith("abil"):
            cut("abil", "" if at("abil") >= r2 else "abl")
        elif w.endswith("ic"):
            cut("ic", "" if at("ic") >= r2 else "iqU")
        elif w.endswith("iv") and at("iv") >= r2:
            cut("iv")
        done = True
    elif s in ("if", "ive", "ifs", "ives") and at(s) >= r2:
        cut(s)
        if w.endswith("at") and at("at") >= r2:
            cut("at")
            if w.endswith("ic"):
                cut("ic", "" if at("ic") >= r2 else "iqU")
        done = True
    elif s == "eaux":
        cut(s, "eau")
        done = True
    elif s == "aux" and at(s) >= r1:
        cut(s, "al")
        done = True
    elif s in ("euse", "euses") and at(s) >= r1:
        cut(s, "" if at(s) >= r2 else "eux")
        done = True
    elif s in ("issement", "issements") and at(s) >= r1 and at(s) > 0 and w[at(s) - 1] not in V:
        cut(s)
        done = True
    elif s == "amment" and at(s) >= rv:
        cut(s, "ant")
        verb = True
    elif s == "emment" and at(s) >= rv:
        cut(s, "ent")
        verb = True
    elif s in ("ment", "ments") and at(s) - 1 >= rv and w[at(s) - 1] in V:
        cut(s)
        verb = True
    if not done or verb:
        step2 = False
        s = _longest(w, S_VERB_I, rv)
        if s and at(s) - 1 >= rv and w[at(s) - 1] not in V and w[at(s) - 1] != "H":
            cut(s)
            step2 = True
        else:
            s = _longest(w, ["ions", *S_VERB_E, *S_VERB_A], rv)
            if s == "ions":
                if at(s) >= r2:
                    cut(s)
                    step2 = True
            elif s in S_VERB_E:
                cut(s)
                step2 = True
            elif s in S_VERB_A:
                cut(s)
                if w.endswith("e") and at("e") >= rv:
                    cut("e")
                step2 = True
        changed = step2
    else:
        changed = True
    if changed:
        if w.endswith("Y"):
            cut("Y", "i")
        elif w.endswith("ç"):
            cut("ç", "c")
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès" or w.endswith("His"):
            cut("s")
        s = _longest(w, ["ion", "ier", "ière", "Ier", "Ière", "e"], rv)
        if s == "ion":
            if at(s) >= r2 and at(s) - 1 >= rv and w[at(s) - 1] in "st":
                cut(s)
        elif s in ("ier", "ière", "Ier", "Ière"):
            cut(s, "i")
        elif s == "e":
            cut("e")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè]([^{V}]+)$", r"e\1", w)
    return w.replace("He", "ë").replace("Hi", "ï").lower()


def stem_column(c: Column) -> Column:
    """Stems of words, by an Arrow function: apply it to a vocabulary of distinct words, not to texts."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w) if w is not None else None)

    return stems(c)


def stem_vocabulary(vocabulary: DataFrame, word: str = "mot") -> DataFrame:
    """(mot, racine) of every distinct alphabetic word."""
    words = vocabulary.select(F.col(word).alias("mot")).where(F.col("mot").rlike(r"^\p{L}+$")).distinct()
    return words.withColumn("racine", stem_column(F.col("mot")))


def normalizer(name: str | None, dictionary: DataFrame | None = None):
    """A function (vocabulary table) -> (mot, racine) by name: 'snowball', 'dictionnaire' or 'none'; an unknown name lowers the case."""
    if name == "snowball":
        return stem_vocabulary
    if name == "dictionnaire" and dictionary is not None:
        return lambda v: lemma_vocabulary(v, dictionary)
    return lambda v: v.select("mot").distinct().withColumn("racine", F.lower("mot"))


def lemma_vocabulary(vocabulary: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(mot, racine): lemmas of a table (mot, lemme); words it lacks stand for themselves."""
    words = vocabulary.select("mot").where(F.col("mot").rlike(r"^\p{L}+$")).distinct()
    known = dictionary.groupBy(F.lower("mot").alias("mot")).agg(F.min("lemme").alias("lemme"))
    return words.join(known, "mot", "left").select("mot", F.coalesce("lemme", "mot").alias("racine"))


def lemma_text(c: Column, lemmas: Column) -> Column:
    """The alphabetic tokens of a text in order, each by its lemma from a map column, else as it is; null texts give an empty list."""
    words = F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: t.rlike(r"^\p{L}+$"))
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(lemmas, t), t))

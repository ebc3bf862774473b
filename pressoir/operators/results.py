"""Decoration, ranking and evaluation of results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_term, word_count


def ordering(name: str) -> list[Column]:
    """'recent', 'ancien', 'pertinence' or 'naturel'; documents without a date last, but first in the natural order; ties by fichier."""
    tie = F.col("fichier").asc()
    return {
        "recent": [F.col("date").desc_nulls_last(), tie], "ancien": [F.col("date").asc_nulls_last(), tie], "pertinence": [F.col("score").desc(), tie],
        "naturel": [F.col("score").asc(), F.col("date").asc_nulls_first(), F.col("numero").asc(), tie],
    }[name]


def first_page(found: DataFrame, name: str, size: int = 50) -> DataFrame:
    """The first ``size`` rows in an order of ``ordering``, with their place from 1 on; only so many rows of each task are sorted together."""
    order = ordering(name)
    return found.orderBy(*order).limit(size).withColumn("rang", F.row_number().over(Window.orderBy(*order)))


def naive_scores(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(fichier, score): ten for each occurrence of a term as a whole word in the title, one in the text; only scores above 0."""
    score = word_count(F.coalesce("titre", F.lit("")), terms) * 10 + word_count(F.coalesce("texte", F.lit("")), terms)
    return docs.select("fichier", score.cast("double").alias("score")).where("score > 0")


def snippet_list(text: str | None, terms: list[str], most: int = 3, around: int = 70) -> list[str]:
    """Up to ``most`` distinct passages around the first matches of any term, all terms in bold; substrings match, case does not matter."""
    terms = [t for t in terms if t]
    if not text or not terms:
        return []
    find = re.compile(any_term(terms), re.I)
    out: list[str] = []
    for m in [*find.finditer(text)][:most]:
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        cut = find.sub(lambda x: f"**{x.group()}**", text[a:b])
        out.append(("... " if a else "") + cut + (" ..." if b < len(text) else ""))
    return list(dict.fromkeys(out))


def snippets(text: Column, terms: list[str], most: int = 3, around: int = 70) -> Column:
    """``snippet_list`` over a column."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_list(t, terms, most, around))

    return cut(text)


def decorate(found: DataFrame, terms: list[str]) -> DataFrame:
    """The found articles with a score of 0 and snippets of their text."""
    return found.withColumn("score", F.lit(0.0)).withColumn("extraits", snippets(F.col("texte"), terms))


def evaluate(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(requete, rappel, precision, taille) per query, for tables (requete, fichier) of results and of truth.

    Both are 0 where their denominator is 0. Results are counted as listed, truth as a set.
    """
    f = found.groupBy("requete").agg(F.count("*").alias("taille"))
    t = truth.distinct().groupBy("requete").agg(F.count("*").alias("vrais"))
    hit = found.distinct().join(truth.distinct(), ["requete", "fichier"], "left_semi").groupBy("requete").agg(F.count("*").alias("justes"))
    out = t.join(f, "requete", "full").join(hit, "requete", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.round(F.when(zero(b) > 0, zero(a) / zero(b)).otherwise(0.0), 6)
    return out.select("requete", ratio("justes", "vrais").alias("rappel"), ratio("justes", "taille").alias("precision"), zero("taille").cast("long").alias("taille"))


def means(evaluated: DataFrame, by: str = "modele") -> DataFrame:
    """Mean recall, precision and size per variant."""
    return evaluated.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("rappel", "precision", "taille")])

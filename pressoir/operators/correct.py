"""Spelling correction of words against a lexicon."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, prefix_score
from ..session import join_margin, materialize


def block_width(least: int, proximity: int) -> int:
    """Letters that every candidate shares: a score of ``proximity`` over at least ``least`` letters needs so many in common."""
    return math.ceil(least * proximity / 100)


def prefix_candidates(words: DataFrame, lexicon: DataFrame, proximity: int = 60, least: int = 3, gap: int = 4) -> DataFrame:
    """(mot, candidat, score): lexicon words whose prefix score reaches ``proximity``.

    A pair of this score shares a part of its longer word's letters from the first on, so words meet on (longer length, that many first letters): a word is
    listed once for each longer length within the gap, and a lexicon word likewise. The longer the words, the narrower their blocks; the equi-join loses nothing. A proximity
    that shares no letter raises ValueError.
    """
    if block_width(least, proximity) < 1:
        raise ValueError("the proximity shares no letter; every pair would have to be compared")

    def blocked(rows: DataFrame, name: str) -> DataFrame:
        size = F.length(name)
        rows = rows.where(size >= least).withColumn("long", F.explode(F.sequence(size, size + gap)))
        width = F.ceil(F.col("long") * proximity / 100).cast("int")
        return rows.where(width <= size).withColumn("bloc", F.substring(F.col(name), F.lit(1), width))

    a = blocked(words.select(F.col("mot")).distinct(), "mot")
    b = blocked(lexicon.select(F.col("mot").alias("candidat")).distinct(), "candidat")
    near = a.join(b, ["long", "bloc"]).where(F.col("long") == F.greatest(F.length("mot"), F.length("candidat")))
    return near.select("mot", "candidat", prefix_score("mot", "candidat", least, gap).alias("score")).where(F.col("score") >= proximity)


def correct_tokens(words: DataFrame, lexicon: DataFrame, proximity: int = 60, least: int = 3, gap: int = 4) -> DataFrame:
    """(mot, correction, methode) of every distinct word.

    DIRECT for a word of the lexicon, PREFIXE for the only candidate, LEV(d) for the candidate at the least edit distance d (ties: higher
    score, then alphabet), NON TROUVÉ with a null correction for the rest. Only misses go through the candidate join.
    """
    words = words.select("mot").where("mot is not null").distinct()
    known = lexicon.select("mot").distinct()
    direct = words.join(known, "mot", "left_semi").select("mot", F.col("mot").alias("correction"), F.lit("DIRECT").alias("methode"))
    misses = words.join(known, "mot", "left_anti")
    pairs = prefix_candidates(misses, lexicon, proximity, least, gap).withColumn("d", F.levenshtein("mot", "candidat"))
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("mot").orderBy("d", F.col("score").desc(), "candidat")))
    best = ranked.where("n = 1").join(pairs.groupBy("mot").agg(F.count("*").alias("combien")), "mot")
    method = F.when(F.col("combien") == 1, F.lit("PREFIXE")).otherwise(F.concat(F.lit("LEV("), F.col("d").cast("string"), F.lit(")")))
    fixed = misses.join(best.select("mot", F.col("candidat").alias("correction"), method.alias("methode")), "mot", "left")
    return direct.unionByName(fixed.withColumn("methode", F.coalesce("methode", F.lit("NON TROUVÉ"))))


def longest_prefix(words: DataFrame, lexicon: DataFrame, least: int = 3, overflow: int | None = None, gap: int | None = None) -> DataFrame:
    """(mot, correction, prefixe): the lexicon word with the longest shared prefix of at least ``least`` letters, then the least distance.

    ``overflow`` caps how far the candidate runs past the prefix, ``gap`` the difference of lengths.
    """
    from ..functions.text import common_prefix

    a = words.select("mot").distinct().withColumn("bloc", F.substring("mot", 1, least)).where(F.length("mot") >= least)
    b = lexicon.select(F.col("mot").alias("candidat")).distinct().withColumn("bloc", F.substring("candidat", 1, least))
    pairs = a.join(b, "bloc").withColumn("prefixe", common_prefix("mot", "candidat"))
    if overflow is not None:
        pairs = pairs.where(F.length("candidat") - F.col("prefixe") <= overflow)
    if gap is not None:
        pairs = pairs.where(F.abs(F.length("candidat") - F.length("mot")) <= gap)
    order = Window.partitionBy("mot").orderBy(F.col("prefixe").desc(), F.levenshtein("mot", "candidat"), "candidat")
    return pairs.withColumn("n", F.row_number().over(order)).where("n = 1").select("mot", F.col("candidat").alias("correction"), "prefixe")


def correct_sentences(sentences: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, piece, correction, methode): every word and sign of each sentence in order; signs are SYMBOLE."""
    pieces = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN + r"|[^\p{L}\p{N}_\s]"), F.lit(0))
    rows = materialize(sentences.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(pieces).alias("pos", "piece")), "mots")
    counts = rows.groupBy("piece").agg(F.count("*").alias("_n"))
    words = counts.where(F.col("piece").rlike(TOKEN)).select(F.col("piece").alias("mot"))
    fixed = materialize(correct_tokens(words, lexicon).withColumnRenamed("mot", "piece").join(counts, "piece"), "corrections")
    out = join_margin(rows, fixed, "piece", F.col("_n"), rows.count() or 1, "left")
    symbol = ~F.col("piece").rlike(TOKEN)
    return out.select(key, "pos", "piece", F.when(symbol, F.col("piece")).otherwise(F.col("correction")).alias("correction"), F.when(symbol, F.lit("SYMBOLE")).otherwise(F.col("methode")).alias("methode"))


def weighted_distance(a: str, b: str, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0) -> float:
    """Edit distance with a cost per kind of edit."""
    row = [j * insert for j in range(len(b) + 1)]
    for x in a:
        new = [row[0] + delete]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + delete, new[j] + insert, row[j] + (0 if x == y else substitute)))
        row = new
    return row[-1]


def weighted_levenshtein(a: Column | str, b: Column | str, insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0) -> Column:
    """``weighted_distance`` of two columns, null where either is; equal costs need no Python."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if insert == delete == substitute:
        return F.levenshtein(a, b) * float(insert)

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(p, q, insert, delete, substitute) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return distance(a, b)


def normalize_terms(terms: DataFrame, dictionary: DataFrame, lexicon: DataFrame, lemmas: DataFrame, term: str = "terme") -> DataFrame:
    """(terme, racine, voie) of every distinct query term: what the index is asked for.

    A word of ``dictionary`` (mot, racine) takes its root there ('DICTIONNAIRE'). Any other is corrected against ``lexicon`` (mot) and looked up again ('CORRIGE');
    what the dictionary still lacks takes its lemma from ``lemmas`` (mot, lemme), corrected or not ('LEMME'), else stands for itself ('INCONNU').
    Terms are compared in lower case; of several roots or lemmas the first in order counts. Null and blank terms give no rows.
    """
    asked = terms.select(F.col(term).alias("terme")).where(F.trim("terme") != "").distinct().withColumn("mot", F.lower(F.trim("terme")))
    roots = dictionary.groupBy(F.lower("mot").alias("mot")).agg(F.min("racine").alias("racine"))
    known = lemmas.groupBy(F.lower("mot").alias("mot")).agg(F.min("lemme").alias("lemme"))
    asked = materialize(asked.join(roots, "mot", "left"), "termes")
    lost = asked.where("racine is null").select("mot").distinct()
    fixed = correct_tokens(lost, lexicon).select("mot", F.coalesce("correction", "mot").alias("corrige"))
    fixed = fixed.join(roots.select(F.col("mot").alias("corrige"), F.col("racine").alias("racine_c")), "corrige", "left").join(known.select(F.col("mot").alias("corrige"), "lemme"), "corrige", "left")
    out = asked.join(fixed, "mot", "left")
    way = F.when(F.col("racine").isNotNull(), "DICTIONNAIRE").when(F.col("racine_c").isNotNull(), "CORRIGE").when(F.col("lemme").isNotNull(), "LEMME").otherwise("INCONNU")
    return out.select("terme", F.coalesce("racine", "racine_c", "lemme", "corrige", "mot").alias("racine"), way.alias("voie"))

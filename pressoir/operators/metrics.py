"""Token counts, TF, IDF, TF-IDF and the stop-list, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import ZONES, read_zones
from ..session import join_margin, materialize


def zone_tokens(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(fichier, zone, token, tf): how often each token occurs in each zone of each document."""
    rows = read_zones(docs, wanted)
    return rows.select("fichier", "zone", F.explode(tokens("contenu")).alias("token")).groupBy("fichier", "zone", "token").agg(F.count("*").alias("tf"))


def corpus_tokens(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(token, tf) over the whole collection."""
    rows = read_zones(docs, wanted)
    return rows.select(F.explode(tokens("contenu")).alias("token")).groupBy("token").agg(F.count("*").alias("tf"))


def term_frequencies(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(document_id, mot, tf): raw counts, summed over zones."""
    rows = read_zones(docs, wanted)
    return rows.select(F.col("fichier").alias("document_id"), F.explode(tokens("contenu")).alias("mot")).groupBy("document_id", "mot").agg(F.count("*").alias("tf"))


def size(tf: DataFrame) -> DataFrame:
    """One row: the number of documents that hold a token."""
    return tf.agg(F.countDistinct("document_id").alias("n"))


def _document_frequencies(tf: DataFrame) -> DataFrame:
    """(mot, df, n) of counts that are read more than once; the number of documents is a one-row broadcast."""
    return tf.groupBy("mot").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size(tf)))


def _idf() -> Column:
    return F.when(F.col("df") < F.col("n"), F.log10(F.col("n") / F.col("df"))).otherwise(0.0)


def idf(tf: DataFrame) -> DataFrame:
    """(mot, df, idf): idf is log10(n/df), 0 for a term of every document. The counts are made once."""
    return _document_frequencies(materialize(tf, "tf")).select("mot", "df", F.round(_idf(), 6).alias("idf"))


def tf_idf(tf: DataFrame) -> DataFrame:
    """(document_id, mot, tf_idf), rounded to 6 decimals. The counts are made once; hot terms are joined by their margins."""
    tf = materialize(tf, "tf")
    df = materialize(_document_frequencies(tf), "df")
    return join_margin(tf, df, "mot", F.col("df"), tf.count() or 1).select("document_id", "mot", F.round(F.col("tf") * _idf(), 6).alias("tf_idf"))


def stop_list(tf: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(mot, remplacement): the terms whose idf is at most ``threshold``, to be replaced by nothing."""
    return idf(tf).where(F.col("idf") <= threshold).select("mot", F.lit("").alias("remplacement"))


def top_terms(scored: DataFrame, document: Column | str, k: int = 10) -> DataFrame:
    """The k terms of one document with the highest TF-IDF, ties by term."""
    return scored.where(F.col("document_id") == document).orderBy(F.col("tf_idf").desc(), "mot").limit(k)


def vocabulary(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(mot): the distinct tokens."""
    return corpus_tokens(docs, wanted).select(F.col("token").alias("mot"))


def shared_roots(roots: DataFrame) -> DataFrame:
    """(racine, mots) for a table (mot, racine): how many distinct words share each root."""
    return roots.groupBy("racine").agg(F.countDistinct("mot").alias("mots"))


def root_histogram(roots: DataFrame) -> DataFrame:
    """(mots, racines, part): how many roots are reached by so many words, and their share of all roots."""
    counts = shared_roots(roots).groupBy("mots").agg(F.count("*").alias("racines"))
    total = counts.agg(F.sum("racines").alias("toutes"))
    return counts.crossJoin(F.broadcast(total)).select("mots", "racines", F.round(F.col("racines") / F.col("toutes"), 6).alias("part"))


def normalizer_stats(roots: DataFrame) -> DataFrame:
    """One row (mots, racines, inchanges, reduction) for a table (mot, racine)."""
    out = roots.agg(F.count("*").alias("mots"), F.countDistinct("racine").alias("racines"), F.coalesce(F.sum((F.col("mot") == F.col("racine")).cast("long")), F.lit(0)).alias("inchanges"))
    return out.select("mots", "racines", "inchanges", F.round(F.when(F.col("mots") > 0, 1 - F.col("racines") / F.col("mots")), 6).alias("reduction"))


__all__ = ["ZONES", "corpus_tokens", "idf", "normalizer_stats", "root_histogram", "shared_roots", "size", "stop_list", "term_frequencies", "tf_idf", "top_terms", "vocabulary", "zone_tokens"]

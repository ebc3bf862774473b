"""Inverted indexes as long tables, re-keyed by roots, with frequencies by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_id, tokens
from ..schema import read_zones
from ..session import join_margin, materialize
from .metrics import zone_tokens


def postings(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(zone, token, fichier), one row per document and zone that hold the token."""
    return zone_tokens(docs, wanted).select("zone", "token", "fichier")


#: Documents in a list of an export form; longer lists are parted into lots of about so many.
LOT = 10_000


def lots(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """The rows with ``lot``: 0 for keys of at most LOT rows, else a number from the document's hash, so that no list grows with the collection."""
    rows = materialize(rows, "lots")
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LOT), "tailles")
    number = F.conv(F.substring(F.md5(F.col(document)), 1, 8), 16, 10).cast("long")
    out = join_margin(rows, sizes, keys, F.col("_n"), rows.count() or 1, "left")
    return out.withColumn("lot", F.coalesce(F.pmod(number, F.ceil(F.col("_n") / LOT)), F.lit(0)).cast("int")).drop("_n")


def inverted_index(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(token, lot, documents, n): per token the distinct documents, sorted, joined by blanks; an export form, not for search."""
    flat = read_zones(docs, wanted)
    rows = flat.select(F.explode(F.array_distinct(tokens("contenu"))).alias("token"), "fichier").distinct()
    return lots(rows, ["token"], "fichier").groupBy("token", "lot").agg(F.array_join(F.sort_array(F.collect_list("fichier")), " ").alias("documents"), F.count("*").alias("n"))


def rekey(index: DataFrame, roots: DataFrame, token: str = "token") -> DataFrame:
    """The postings with each token replaced by its root from a table (mot, racine) of distinct words; tokens it lacks stay. Repeated postings fall together.

    Hot tokens are joined by their margins."""
    index = materialize(index, "postings")
    counts = index.groupBy(token).agg(F.count("*").alias("_n"))
    known = materialize(roots.select(F.col("mot").alias(token), "racine").join(counts, token), "racines")
    out = join_margin(index, known, token, F.col("_n"), index.count() or 1, "left").drop("_n")
    return out.withColumn(token, F.coalesce("racine", token)).drop("racine").distinct()


def field_frequencies(docs: DataFrame) -> DataFrame:
    """(champ, terme, document_id, tf) of eight fields: numero, date, rubrique as lower-case facets, titre, texte, both together, image
    urls as they are, captions by tokens."""
    text = lambda c: tokens(F.coalesce(F.col(c), F.lit("")))
    facet = lambda c: F.array_compact(F.array(F.lower(c)))
    urls = F.filter(F.transform(F.coalesce("images", F.array()), lambda x: x["url"]), lambda u: u.isNotNull() & (u != ""))
    legends = F.flatten(F.transform(F.coalesce("images", F.array()), lambda x: tokens(F.coalesce(x["legende"], F.lit("")))))
    fields = {
        "numero": facet(F.col("numero")), "date": facet(F.date_format("date", "yyyy-MM-dd")), "rubrique": facet(F.col("rubrique")), "titre": text("titre"), "texte": text("texte"),
        "titre_texte": F.concat(text("titre"), text("texte")), "images_url": urls, "images_legende": legends,
    }
    pairs = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    rows = docs.select(document_id("fichier").alias("document_id"), F.explode(pairs).alias("champ", "termes"))
    return rows.select("champ", F.explode("termes").alias("terme"), "document_id").groupBy("champ", "terme", "document_id").agg(F.count("*").alias("tf"))


def frequency_lines(frequencies: DataFrame) -> DataFrame:
    """(champ, terme, lot, documents): 'id:count id:count', ids sorted."""
    pair = F.struct("document_id", "tf")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.concat_ws(":", x["document_id"], x["tf"])), " ")
    return lots(frequencies, ["champ", "terme"], "document_id").groupBy("champ", "terme", "lot").agg(joined.alias("documents"))


def matching(index: DataFrame, terms: list[str], operator: str | None = "AND", zone: str = "texte", strict: bool = False) -> DataFrame:
    """(fichier) of the documents that hold all or any of the terms in a zone.

    A term of several words is the conjunction of its tokens, which must all be held; with ``strict`` it is one key of the index and
    so never found. No terms: no documents. Relational division over one scan of the zone's postings.
    """
    groups = [[t.lower()] if strict else t.lower().replace("'", " ").replace("-", " ").split() for t in terms]
    groups = [g for g in groups if g]
    hits = index.where((F.col("zone") == zone) & F.col("token").isin(*sorted({w for g in groups for w in g})) if groups else F.lit(False))
    found = hits.groupBy("fichier").agg(F.collect_set("token").alias("mots"))
    each = [F.size(F.array_intersect("mots", F.array(*map(F.lit, sorted(set(g)))))) == len(set(g)) for g in groups]
    if not each:
        return found.select("fichier")
    test = each[0]
    for e in each[1:]:
        test = test | e if operator == "OR" else test & e
    return found.where(test).select("fichier")

"""Queries of the retrieval engine over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.stem import lemma_text, lemma_vocabulary, stem_vocabulary
from .operators import correct, metrics, postings, results
from .plans import boolean, compile
from .plans.ir import StructuredQuery
from .plans.parser import QueryBuilder, QueryParser
from .schema import archive, check_keys, read_zones, zoned_archive, zones
from .session import shared_dir, until_exit
from .sources import html, tables, xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# SQL that the oracles share
DOCS = """docs AS (SELECT fichier, numero, date_pub AS date, rubrique, titre, auteur, contact, texte, images FROM articles WHERE fichier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fichier ORDER BY recu_le DESC NULLS LAST) = 1),
zoned AS (SELECT fichier, coalesce(titre, '') AS titre, coalesce(texte, '') AS texte, coalesce(array_to_string(list_transform(images, lambda x: coalesce(x.legende, '')), ''), '') AS legendes FROM docs),
long AS (SELECT fichier, 'titre' AS zone, titre AS contenu FROM zoned UNION ALL SELECT fichier, 'texte', texte FROM zoned UNION ALL SELECT fichier, 'legendes', legendes FROM zoned),
toks AS (SELECT fichier, zone, unnest(regexp_extract_all(lower(contenu), '[\\p{L}\\p{N}_]+')) AS token FROM long),
tf AS (SELECT fichier AS document_id, token AS mot, count(*) AS tf FROM toks GROUP BY ALL),
dfs AS (SELECT mot, count(*) AS df FROM tf GROUP BY ALL), size AS (SELECT count(DISTINCT document_id) AS n FROM tf),
idfs AS (SELECT mot, df, CASE WHEN df < n THEN log10(n / df) ELSE 0.0 END AS idf FROM dfs, size)"""
RESULT = "fichier, date, rubrique, titre"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL after the shared views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {DOCS} {sql}" if sql.lstrip().upper().startswith("SELECT") else f"WITH {DOCS}, {sql.strip()}"
        return f

    return register


def _result(found: DataFrame) -> DataFrame:
    return found.select("fichier", "date", "rubrique", "titre")


_indexes: dict[tuple[str, str], str] = {}


def search_index(spark: SparkSession, d: str) -> DataFrame:
    """The written index of a folder's archive: built once a session, read by every search; searches read the rows of their zones and tokens only."""
    key = (spark.sparkContext.applicationId, d)
    if key in _indexes:
        try:
            return tables.read_postings(spark, _indexes[key])
        except AnalysisException:  # its folder was cleared
            del _indexes[key]
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    tables.write_postings(postings.postings(zoned_archive(spark, d)), path)
    _indexes[key] = until_exit(spark, path)
    return tables.read_postings(spark, path)


def _listed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The archive with the columns of a result list, and more where criteria need them."""
    return archive(spark, d, ("fichier", "date", "rubrique", "titre", *more))


def _found(spark: SparkSession, d: str, query: StructuredQuery) -> DataFrame:
    terms = query.content_terms or query.title_terms or query.negated_content_terms
    return compile.search(_listed(spark, d, *["images"] * query.has_image), search_index(spark, d) if terms else None, query)


def _search(spark: SparkSession, d: str, **criteria) -> DataFrame:
    return _result(_found(spark, d, StructuredQuery(**criteria)))


def _ask(spark: SparkSession, d: str, question: str, builder: QueryBuilder | None = None) -> DataFrame:
    asked = (builder or QueryParser()).build(question)
    found = _found(spark, d, asked)
    return found if asked.target == "rubriques" else _result(found)


def _holds(word: str, zone: str = "texte") -> str:
    return f"fichier IN (SELECT fichier FROM toks WHERE zone = '{zone}' AND token = '{word}')"


# documents, zones, tokens


@query(f"SELECT {RESULT}, numero, auteur, contact, texte, len(images) AS n_images FROM docs")
def documents_archive(spark, d):
    return archive(spark, d).select("fichier", "date", "rubrique", "titre", "numero", "auteur", "contact", "texte", F.when(F.col("images").isNotNull(), F.size("images")).cast("long").alias("n_images"))


@query("SELECT CASE WHEN fichier IS NULL THEN 'cle nulle' ELSE 'cle repetee' END AS probleme, fichier, count(*) AS lignes FROM articles GROUP BY fichier HAVING fichier IS NULL OR count(*) > 1")
def key_check(spark, d):
    return check_keys(spark.read.parquet(f"{d}/articles.parquet"))


@query("SELECT fichier, zone, contenu FROM long")
def read_zones_long(spark, d):
    return read_zones(zoned_archive(spark, d))


@query("SELECT fichier, zone, token, count(*) AS tf FROM toks GROUP BY ALL")
def zone_tokens(spark, d):
    return metrics.zone_tokens(zoned_archive(spark, d))


@query("SELECT token, count(*) AS tf FROM toks GROUP BY ALL")
def tokens_corpus(spark, d):
    return metrics.corpus_tokens(zoned_archive(spark, d))


@query("SELECT token, count(*) AS tf FROM toks WHERE zone IN ('titre', 'legendes') GROUP BY ALL")
def tokens_by_zone(spark, d):
    return metrics.corpus_tokens(zoned_archive(spark, d, ("titre", "legendes")), ("titre", "legendes"))


@query("SELECT DISTINCT token AS mot FROM toks")
def vocabulary(spark, d):
    return metrics.vocabulary(zoned_archive(spark, d)).orderBy("mot")


# metrics


@query("SELECT * FROM tf")
def term_frequency(spark, d):
    return metrics.term_frequencies(zoned_archive(spark, d))


@query("SELECT n FROM size")
def corpus_size(spark, d):
    return metrics.size(metrics.term_frequencies(zoned_archive(spark, d)))


@query("SELECT mot, df, round(idf, 6) AS idf FROM idfs")
def df_idf(spark, d):
    return metrics.idf(metrics.term_frequencies(zoned_archive(spark, d)))


@query("SELECT mot, df, round(idf, 6) AS idf FROM idfs ORDER BY round(idf, 6), mot LIMIT 20")
def lowest_idf(spark, d):
    return metrics.idf(metrics.term_frequencies(zoned_archive(spark, d))).orderBy("idf", "mot").limit(20)


@query("SELECT document_id, mot, round(tf * idf, 6) AS tf_idf FROM tf JOIN idfs USING (mot)")
def tfidf(spark, d):
    return metrics.tf_idf(metrics.term_frequencies(zoned_archive(spark, d)))


@query("SELECT document_id, mot, round(tf * idf, 6) AS tf_idf FROM tf JOIN idfs USING (mot) WHERE document_id = '500001.htm' ORDER BY round(tf * idf, 6) DESC, mot LIMIT 10")
def tfidf_topk(spark, d):
    return metrics.top_terms(metrics.tf_idf(metrics.term_frequencies(zoned_archive(spark, d))), "500001.htm")


@query("SELECT mot, '' AS remplacement FROM idfs WHERE round(idf, 6) <= 0.1")
def stoplist_fr(spark, d):
    return metrics.stop_list(metrics.term_frequencies(zoned_archive(spark, d)))


# postings


@query("SELECT DISTINCT zone, token, fichier FROM toks")
def postings_flat(spark, d):
    return postings.postings(zoned_archive(spark, d))


_LOT = "CAST(CASE WHEN k > 10000 THEN CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % CAST(ceil(k / 10000) AS BIGINT) ELSE 0 END AS INT) AS lot"


@query("x AS (SELECT DISTINCT token, fichier, count(*) OVER (PARTITION BY token) AS k FROM (SELECT DISTINCT token, fichier FROM toks)), y AS (SELECT token, fichier, " + _LOT.format("fichier") + " FROM x) SELECT token, lot, string_agg(fichier, ' ' ORDER BY fichier) AS documents, count(*) AS n FROM y GROUP BY token, lot")
def inverted_index(spark, d):
    return postings.inverted_index(zoned_archive(spark, d))


_FREQ = """f AS (SELECT translate(fichier, ' ,', '_;') AS document_id, 'numero' AS champ, [lower(numero)] AS t FROM docs UNION ALL SELECT translate(fichier, ' ,', '_;'), 'date', [strftime(date, '%Y-%m-%d')] FROM docs
 UNION ALL SELECT translate(fichier, ' ,', '_;'), 'rubrique', [lower(rubrique)] FROM docs UNION ALL SELECT translate(fichier, ' ,', '_;'), 'images_url', list_transform(images, lambda x: nullif(x.url, '')) FROM docs
 UNION ALL SELECT translate(fichier, ' ,', '_;'), 'titre', regexp_extract_all(lower(titre), '[\\p{L}\\p{N}_]+') FROM zoned UNION ALL SELECT translate(fichier, ' ,', '_;'), 'texte', regexp_extract_all(lower(texte), '[\\p{L}\\p{N}_]+') FROM zoned
 UNION ALL SELECT translate(fichier, ' ,', '_;'), 'titre_texte', regexp_extract_all(lower(titre || chr(10) || texte), '[\\p{L}\\p{N}_]+') FROM zoned
 UNION ALL SELECT translate(fichier, ' ,', '_;'), 'images_legende', flatten(list_transform(coalesce(images, []), lambda x: regexp_extract_all(lower(coalesce(x.legende, '')), '[\\p{L}\\p{N}_]+'))) FROM docs),
 g AS (SELECT champ, unnest(t) AS terme, document_id FROM f), h AS (SELECT champ, terme, document_id, count(*) AS tf FROM g WHERE terme IS NOT NULL GROUP BY ALL)"""


@query(_FREQ + " SELECT * FROM h")
def freq_index(spark, d):
    return postings.field_frequencies(archive(spark, d))


@query(_FREQ + ", i AS (SELECT *, count(*) OVER (PARTITION BY champ, terme) AS k FROM h), j AS (SELECT *, " + _LOT.format("document_id") + " FROM i) SELECT champ, terme, lot, string_agg(document_id || ':' || tf, ' ' ORDER BY document_id) AS documents FROM j GROUP BY champ, terme, lot")
def freq_lines(spark, d):
    return postings.frequency_lines(postings.field_frequencies(archive(spark, d)))


_LEMMAS = [("capteurs", "capteur"), ("batteries", "batterie"), ("mesures", "mesure"), ("essais", "essai"), ("communes", "commune"), ("étudiantes", "étudiante"), ("chercheurs", "chercheur"), ("montrent", "montrer"), ("résiste", "résister")]


def _lemmas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LEMMAS, "mot string, lemme string")


_LEMMA_SQL = "lem(mot, lemme) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LEMMAS) + ")"


@query(_LEMMA_SQL + " SELECT DISTINCT zone, coalesce(lemme, token) AS token, fichier FROM toks LEFT JOIN lem ON mot = token")
def lemma_postings(spark, d):
    docs = zoned_archive(spark, d)
    return postings.rekey(postings.postings(docs), lemma_vocabulary(metrics.vocabulary(docs), _lemmas(spark)))


@query()
def stem_postings(spark, d):
    docs = zoned_archive(spark, d)
    return postings.rekey(postings.postings(docs), stem_vocabulary(metrics.vocabulary(docs)))


# filters


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND date >= '2012-01-01' AND date <= '2013-12-31 23:59:59.999999'")
def search_and_date(spark, d):
    return _search(spark, d, content_terms=("couche",), date_start=datetime(2012, 1, 1), date_end=datetime(2013, 12, 31, 23, 59, 59, 999999))


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('mesures')} AND {_holds('couche')}")
def search_and(spark, d):
    return _search(spark, d, content_terms=("mesures", "couche"), content_operator="AND")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('capteur')} OR {_holds('batterie')}")
def search_or(spark, d):
    return _search(spark, d, content_terms=("capteur", "batterie"), content_operator="OR")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('grande')} AND {_holds('échelle')} AND {_holds('couche')}")
def search_phrase_terms(spark, d):
    return _search(spark, d, content_terms=("grande échelle", "couche"))


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND NOT ({_holds('grande')} AND {_holds('échelle')}) AND NOT {_holds('mesures')}")
def search_negated(spark, d):
    return _search(spark, d, content_terms=("couche",), negated_content_terms=("grande échelle", "mesures"))


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('secours', 'titre')} OR {_holds('projet', 'titre')}")
def search_title(spark, d):
    return _search(spark, d, title_terms=("secours", "projet"), title_operator="OR")


@query(f"SELECT {RESULT} FROM docs WHERE contains(lower(rubrique), 'santé') OR contains(lower(rubrique), 'robotique')")
def rubric_any(spark, d):
    return _search(spark, d, rubric_terms=("santé", "robotique"))


@query(f"SELECT {RESULT} FROM docs WHERE contains(lower(rubrique), 'eau') AND contains(lower(rubrique), 'assainissement')")
def rubric_all(spark, d):
    return _search(spark, d, rubric_terms=("eau", "assainissement"), rubric_operator="AND")


@query(f"SELECT {RESULT} FROM docs WHERE rubrique IS NULL OR NOT (contains(lower(rubrique), 'santé') OR contains(lower(rubrique), 'robotique'))")
def rubric_exclude(spark, d):
    return _search(spark, d, negated_rubric_terms=("santé", "robotique"))


@query(f"SELECT {RESULT} FROM docs WHERE contains(strip_accents(lower(rubrique)), 'sante')")
def rubric_folded(spark, d):
    return _result(compile.select(_listed(spark, d), None, StructuredQuery(rubric_terms=("santé",)), folded=True))


@query(f"SELECT {RESULT} FROM docs WHERE len(list_filter(images, lambda x: x.url <> '')) > 0")
def has_image(spark, d):
    return _search(spark, d, has_image=True)


@query(f"SELECT {RESULT} FROM docs WHERE date >= '2012-05-01' AND date <= '2012-08-31 23:59:59.999999'")
def date_window(spark, d):
    return _search(spark, d, date_start=datetime(2012, 5, 1), date_end=datetime(2012, 8, 31, 23, 59, 59, 999999))


@query(f"SELECT {RESULT} FROM docs WHERE date < '2011-10-01'")
def date_before(spark, d):
    return _result(_listed(spark, d).where(F.col("date") < F.lit("2011-10-01").cast("timestamp")))


@query(f"SELECT {RESULT} FROM docs WHERE date IS NULL OR NOT (date BETWEEN '2012-06-01' AND '2012-06-30 23:59:59.999999' OR date BETWEEN '2013-01-01' AND '2013-12-31 23:59:59.999999')")
def exclude_periods(spark, d):
    return _search(spark, d, excluded_periods=("2012-06", "2013", "illisible"))


@query(f"SELECT DISTINCT rubrique FROM docs WHERE rubrique <> '' AND {_holds('couche')}")
def rubrics_of_articles(spark, d):
    return _found(spark, d, StructuredQuery(content_terms=("couche",), target="rubriques"))


@query(f"SELECT {RESULT} FROM docs WHERE ({_holds('capteur')} OR {_holds('pile')}) AND NOT {_holds('projet', 'titre')} AND date >= '2012-01-01'")
def boolean_grammar(spark, d):
    docs = archive(spark, d, ("fichier", "date", "rubrique", "titre", "texte", "images")).withColumn("t", F.col("titre"))
    rows = zones(docs, keep=("date", "rubrique", "t"))
    return rows.where(boolean.condition(boolean.parse("(capteur ou pile) et pas titre:projet depuis 2012"))).select("fichier", "date", "rubrique", F.col("t").alias("titre"))


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND {_holds('projet', 'titre')}")
def search_zone_fallback(spark, d):
    asked = StructuredQuery(content_terms=("couche",), title_terms=("projet",))
    return _result(compile.select(_listed(spark, d), search_index(spark, d), asked, content=("content", "texte"), title=("title", "titre")))


@query(f"SELECT {RESULT} FROM docs WHERE false")
def search_empty_index(spark, d):
    return _result(compile.select(_listed(spark, d), search_index(spark, d).where("zone = 'inconnue'"), StructuredQuery(content_terms=("couche",))))


@query(f"SELECT count(*) AS resultats FROM docs WHERE {_holds('couche')}")
def result_count(spark, d):
    return _search(spark, d, content_terms=("couche",)).agg(F.count("*").alias("resultats"))


_SCORED = """r AS (SELECT fichier, date, numero, CAST(10 * len(list_filter(regexp_extract_all(lower(z.titre), '[\\p{L}\\p{N}_]+'), lambda x: x IN ('couche', 'projet'))) + len(list_filter(regexp_extract_all(lower(z.texte), '[\\p{L}\\p{N}_]+'), lambda x: x IN ('couche', 'projet'))) AS DOUBLE) AS score FROM zoned z JOIN docs USING (fichier)),
 p AS (SELECT * FROM r WHERE score > 0)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = archive(spark, d, ("fichier", "date", "numero", "titre", "texte"))
    return docs.select("fichier", "date", "numero").join(results.naive_scores(docs, ["couche", "projet"]), "fichier")


def _page_sql(order: str) -> str:
    return f"{_SCORED} SELECT fichier, date, score, CAST(row_number() OVER (ORDER BY {order}, fichier) AS INT) AS rang FROM p ORDER BY {order}, fichier LIMIT 50"


@query(_page_sql("date DESC NULLS LAST"))
def page_recent(spark, d):
    return results.first_page(_scored(spark, d), "recent").select("fichier", "date", "score", "rang")


@query(_page_sql("date ASC NULLS LAST"))
def page_oldest(spark, d):
    return results.first_page(_scored(spark, d), "ancien").select("fichier", "date", "score", "rang")


@query(_page_sql("score DESC"))
def page_relevance(spark, d):
    return results.first_page(_scored(spark, d), "pertinence").select("fichier", "date", "score", "rang")


@query(_page_sql("score ASC, date ASC NULLS FIRST, numero ASC NULLS FIRST"))
def page_natural(spark, d):
    return results.first_page(_scored(spark, d), "naturel").select("fichier", "date", "score", "rang")


# questions


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('capteur')} OR {_holds('batterie')}")
def nl_search_or(spark, d):
    return _ask(spark, d, "Trouver des articles qui traitent de capteur ou de batterie")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND date BETWEEN '2012-03-03' AND '2013-05-04 23:59:59.999999'")
def nl_search_range(spark, d):
    return _ask(spark, d, "Afficher ce qui est paru entre le 3 mars 2012 et le 4 mai 2013 et mentionne la couche")


@query(f"SELECT {RESULT} FROM docs WHERE ({_holds('capteur')} OR {_holds('couche')}) AND NOT ({_holds('grande')} AND {_holds('échelle')})")
def nl_search_negated(spark, d):
    return _ask(spark, d, "Chercher soit le capteur, soit la couche, mais pas de grande échelle")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('projet', 'titre')} AND len(list_filter(images, lambda x: x.url <> '')) > 0")
def nl_search_title_image(spark, d):
    return _ask(spark, d, "Afficher les bulletins avec des photos dont le titre contient projet")


@query(f"SELECT DISTINCT rubrique FROM docs WHERE rubrique <> '' AND {_holds('capteur')}")
def nl_search_rubrics(spark, d):
    return _ask(spark, d, "Dans quelles rubriques parle-t-on du capteur ?")


@query(f"SELECT {RESULT} FROM docs WHERE date BETWEEN '2012-01-01' AND '2013-12-31 23:59:59.999999' AND NOT date BETWEEN '2012-06-01' AND '2012-06-30 23:59:59.999999' AND NOT date BETWEEN '2013-06-01' AND '2013-06-30 23:59:59.999999'")
def nl_search_month(spark, d):
    return _ask(spark, d, "Articles publiés de 2012 à 2013, sauf en juin")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND contains(lower(rubrique), 'astronomie') AND date >= '2012-07-01'")
def nl_search_after(spark, d):
    return _ask(spark, d, "Afficher la couche dans la rubrique Astronomie, bulletins publiés depuis juillet 2012")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND date BETWEEN '2013-01-01' AND '2013-12-31 23:59:59.999999'")
def nl_search_year(spark, d):
    return _ask(spark, d, "La couche pendant l'année 2013")


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND (contains(lower(rubrique), 'astronomie') OR contains(lower(rubrique), 'toxicologie'))")
def nl_search_rubric_pair(spark, d):
    return _ask(spark, d, 'La couche dans la rubrique "Astronomie" ou "Toxicologie"')


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('couche')} AND contains(lower(rubrique), 'toxicologie')")
def nl_search_implicit(spark, d):
    return _ask(spark, d, "La couche et toxicologie", QueryParser(("astronomie", "toxicologie")))


@query(f"SELECT {RESULT} FROM docs WHERE {_holds('les')}")
def nl_search_fallback(spark, d):
    return _ask(spark, d, "les")


# text functions


_TRIMMED = "regexp_replace(texte, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT fichier, regexp_replace(translate(lower({_TRIMMED}), '''', ' '), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS texte FROM docs")
def standardize(spark, d):
    return archive(spark, d).select("fichier", T.standardize("texte").alias("texte"))


@query("SELECT fichier, regexp_replace(translate(lower(regexp_replace(titre, '^\\s+|\\s+$', '', 'g')), '-''', '  '), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS app, translate(regexp_replace(lower(regexp_replace(titre, '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '''', ' ') AS inerte FROM docs")
def standardize_variants(spark, d):
    return archive(spark, d).select("fichier", T.standardize("titre", hyphens=True).alias("app"), T.standardize("titre", inert_apostrophe=True).alias("inerte"))


_MAP = {"capteur": "senseur", "été": "ETE", "couche": "", "batterie": "pile"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MAP.items())


@query(f"SELECT fichier, array_to_string(list_transform(regexp_extract_all(texte, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: CASE lower(x) {_CASES} ELSE x END), '') AS texte FROM docs")
def substitute(spark, d):
    table = F.create_map(*[F.lit(x) for kv in _MAP.items() for x in kv])
    return archive(spark, d).select("fichier", T.substitute("texte", table).alias("texte"))


@query("""s AS (SELECT list(mot) AS l FROM idfs WHERE round(idf, 6) <= 0.1)
 SELECT fichier, array_to_string(list_transform(regexp_extract_all(texte, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda x: CASE WHEN list_contains(l, lower(x)) THEN '' ELSE x END), '') AS texte FROM docs, s""")
def stoplist_apply(spark, d):
    # broadcast under a bound: a stop-word stands in 79 % of all documents (idf 0.1), so there are no more of them than a document's mean of distinct words, divided by 0.79
    docs = archive(spark, d)
    stops = metrics.stop_list(metrics.term_frequencies(docs)).agg(F.map_from_arrays(F.collect_list("mot"), F.collect_list("remplacement")).alias("table"))
    return docs.crossJoin(F.broadcast(stops)).select("fichier", T.substitute("texte", F.col("table")).alias("texte"))


@query("SELECT fichier, list_transform(images, lambda x: upper(x.legende))[1] AS legende, upper(titre) AS titre FROM docs")
def apply_filter(spark, d):
    docs = T.apply_filter(archive(spark, d), ["titre", "images.legende", "date"], F.upper)
    return docs.select("fichier", F.get("images.legende", F.lit(0)).alias("legende"), "titre")


@query("""s AS (SELECT fichier, CAST(10 * len(list_filter(regexp_extract_all(lower(titre), '[\\p{L}\\p{N}_]+'), lambda x: x IN ('couche', 'projet'))) + len(list_filter(regexp_extract_all(lower(texte), '[\\p{L}\\p{N}_]+'), lambda x: x IN ('couche', 'projet'))) AS DOUBLE) AS score FROM zoned)
 SELECT fichier, score FROM s WHERE score > 0""")
def naive_score(spark, d):
    return results.naive_scores(archive(spark, d), ["couche", "projet"]).orderBy(*[F.col("score").desc(), "fichier"])


@query("SELECT fichier, regexp_replace(titre, '(secours|pro)', '**\\1**', 'gi') AS titre FROM docs")
def title_highlight(spark, d):
    return archive(spark, d).select("fichier", T.highlight("titre", ["pro", "secours"]).alias("titre"))


@query("SELECT fichier, translate(fichier, ' ,', '_;') AS id, strftime(date, '%d/%m/%Y') AS jour, CAST(strptime(strftime(date, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS lu, date_trunc('month', date) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS fin_mois FROM docs")
def date_functions(spark, d):
    docs = archive(spark, d).withColumn("jour", F.date_format("date", "dd/MM/yyyy"))
    return docs.select("fichier", T.document_id("fichier").alias("id"), "jour", T.slash_date("jour").alias("lu"), T.period_end("date", "month").alias("fin_mois"))


_SIGNS = "translate({0}, '’‘‛«»“”', '''''''\"\"\"\"')"


@query(f"SELECT fichier, {_SIGNS.format('titre')} AS titre, {_SIGNS.format('texte')} AS texte FROM docs")
def normalize_signs(spark, d):
    return archive(spark, d, ("fichier", "titre", "texte")).select("fichier", T.normalize_signs("titre").alias("titre"), T.normalize_signs("texte").alias("texte"))


@query("SELECT fichier, strftime(date, '%d %B %Y') AS affiche FROM docs")
def display_dates(spark, d):
    return archive(spark, d, ("fichier", "date")).select("fichier", T.display_date("date").alias("affiche"))


@query("x AS (SELECT fichier, coalesce(strftime(date, CASE WHEN len(fichier) % 2 = 0 OR fichier < '505' THEN '%d/%m/%Y' ELSE '%Y-%m-%d' END), numero) AS t FROM docs) SELECT fichier, t, regexp_full_match(t, '[0-9]{2}/[0-9]{2}/[0-9]{4}') AS valide FROM x")
def slash_date_check(spark, d):
    form = F.when((F.length("fichier") % 2 == 0) | (F.col("fichier") < "505"), F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    return archive(spark, d, ("fichier", "date", "numero")).select("fichier", F.coalesce(form, "numero").alias("t")).withColumn("valide", T.is_slash_date("t"))


@query("""t AS (SELECT *, list_filter(range(1, len(texte) + 1), lambda i: lower(substr(texte, i, 6)) = 'couche')[1:3] AS places FROM docs WHERE """ + _holds("couche") + """),
 p AS (SELECT fichier, texte, places, list_transform(places, lambda i: (CASE WHEN i > 71 THEN '... ' ELSE '' END) || regexp_replace(substr(texte, greatest(i - 70, 1), least(len(texte), i + 75) - greatest(i - 70, 1) + 1), '(couche)', '**\\1**', 'gi') || (CASE WHEN i + 75 < len(texte) THEN ' ...' ELSE '' END)) AS x FROM t)
 SELECT fichier, 0.0 AS score, array_to_string(list_filter(x, lambda s, i: list_position(x, s) = i), ' | ') AS extraits FROM p""")
def snippets(spark, d):
    docs = archive(spark, d, ("fichier", "date", "texte"))
    found = compile.search(docs, search_index(spark, d), StructuredQuery(content_terms=("couche",)))
    return results.decorate(found, ["couche"]).select("fichier", "score", F.array_join("extraits", " | ").alias("extraits"))


# correction


_ASCII = "w AS (SELECT DISTINCT token AS mot FROM (SELECT unnest(regexp_extract_all(lower(raw_query), '[\\p{L}\\p{N}_]+')) AS token FROM requetes) WHERE regexp_full_match(token, '[a-z]+')), lex AS (SELECT DISTINCT token AS mot FROM toks WHERE zone = 'titre' AND regexp_full_match(token, '[a-z]+'))"
_PAIRS = """m AS (SELECT mot FROM w WHERE mot NOT IN (SELECT mot FROM lex)), p0 AS (SELECT m.mot, lex.mot AS candidat FROM m JOIN lex ON left(m.mot, 2) = left(lex.mot, 2) WHERE abs(len(m.mot) - len(lex.mot)) <= 4 AND len(m.mot) >= 3 AND len(lex.mot) >= 3),
 p AS (SELECT mot, candidat, CAST(floor(100.0 * len(list_filter(range(1, least(len(mot), len(candidat)) + 1), lambda i: left(mot, i) = left(candidat, i))) / greatest(len(mot), len(candidat))) AS BIGINT) AS score FROM p0)"""


def _words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = spark.read.parquet(f"{d}/requetes.parquet").select(F.explode(T.tokens("raw_query")).alias("mot")).where(F.col("mot").rlike("^[a-z]+$")).distinct()
    lexicon = metrics.vocabulary(zoned_archive(spark, d, ("titre",)), ("titre",)).where(F.col("mot").rlike("^[a-z]+$"))
    return asked, lexicon


def _all_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every distinct word of the queries, and the words of all zones; ``_words`` has the part that SQL can follow."""
    return spark.read.parquet(f"{d}/requetes.parquet").select(F.explode(T.tokens("raw_query")).alias("mot")).distinct(), metrics.vocabulary(zoned_archive(spark, d))


@query(f"{_ASCII}, {_PAIRS} SELECT mot, candidat, score FROM p WHERE score >= 60")
def prefix_candidates(spark, d):
    words, lexicon = _words(spark, d)
    return correct.prefix_candidates(words.join(lexicon, "mot", "left_anti"), lexicon)


@query(f"""{_ASCII}, {_PAIRS}, r AS (SELECT mot, candidat, score, levenshtein(mot, candidat) AS d, count(*) OVER (PARTITION BY mot) AS k, row_number() OVER (PARTITION BY mot ORDER BY levenshtein(mot, candidat), score DESC, candidat) AS n FROM p WHERE score >= 60)
 SELECT mot, mot AS correction, 'DIRECT' AS methode FROM w WHERE mot IN (SELECT mot FROM lex) UNION ALL SELECT mot, candidat, CASE WHEN k = 1 THEN 'PREFIXE' ELSE 'LEV(' || d || ')' END FROM r WHERE n = 1
 UNION ALL SELECT mot, NULL, 'NON TROUVÉ' FROM m WHERE mot NOT IN (SELECT mot FROM r)""")
def correct_tokens(spark, d):
    words, lexicon = _words(spark, d)
    return correct.correct_tokens(words, lexicon)


@query(f"""{_ASCII}, q AS (SELECT w.mot, lex.mot AS c, len(list_filter(range(1, least(len(w.mot), len(lex.mot)) + 1), lambda i: left(w.mot, i) = left(lex.mot, i))) AS l FROM w JOIN lex ON left(w.mot, 3) = left(lex.mot, 3) WHERE len(w.mot) >= 3)
 SELECT mot, c AS correction, l AS prefixe FROM q QUALIFY row_number() OVER (PARTITION BY mot ORDER BY l DESC, levenshtein(mot, c), c) = 1""")
def longest_prefix(spark, d):
    words, lexicon = _words(spark, d)
    return correct.longest_prefix(words, lexicon)


@query()
def correct_sentences(spark, d):
    _, lexicon = _all_words(spark, d)
    return correct.correct_sentences(spark.read.parquet(f"{d}/requetes.parquet").select("query_id", "raw_query").distinct(), lexicon, "query_id", "raw_query")


# DuckDB's levenshtein counts bytes, so words with accents have no SQL


@query()
def prefix_candidates_whole(spark, d):
    words, lexicon = _all_words(spark, d)
    return correct.prefix_candidates(words.join(lexicon, "mot", "left_anti"), lexicon)


@query()
def correct_tokens_whole(spark, d):
    return correct.correct_tokens(*_all_words(spark, d))


@query()
def longest_prefix_whole(spark, d):
    return correct.longest_prefix(*_all_words(spark, d))


_LEARNT = "dic(mot, racine) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LEMMAS[:6]) + ")"


@query(f"""{_ASCII}, {_PAIRS}, {_LEARNT}, {_LEMMA_SQL}, r AS (SELECT mot, candidat, row_number() OVER (PARTITION BY mot ORDER BY levenshtein(mot, candidat), score DESC, candidat) AS n FROM p WHERE score >= 60),
 c AS (SELECT w.mot, dic.racine, coalesce(r.candidat, w.mot) AS corrige FROM w LEFT JOIN dic USING (mot) LEFT JOIN r ON r.mot = w.mot AND r.n = 1)
 SELECT c.mot AS terme, coalesce(c.racine, e.racine, lem.lemme, corrige) AS racine, CASE WHEN c.racine IS NOT NULL THEN 'DICTIONNAIRE' WHEN e.racine IS NOT NULL THEN 'CORRIGE' WHEN lem.lemme IS NOT NULL THEN 'LEMME' ELSE 'INCONNU' END AS voie
 FROM c LEFT JOIN dic e ON e.mot = corrige LEFT JOIN lem ON lem.mot = corrige""")
def query_terms(spark, d):
    words, lexicon = _words(spark, d)
    dictionary = spark.createDataFrame(_LEMMAS[:6], "mot string, racine string")
    return correct.normalize_terms(words, dictionary, lexicon, _lemmas(spark), "mot")


@query()
def query_terms_whole(spark, d):
    words, lexicon = _all_words(spark, d)
    return correct.normalize_terms(words, spark.createDataFrame(_LEMMAS[:6], "mot string, racine string"), lexicon, _lemmas(spark), "mot")


@query(f"{_ASCII} SELECT mot, 2.0 * levenshtein(mot, 'capteur') AS distance FROM w")
def weighted_distances(spark, d):
    return _words(spark, d)[0].select("mot", correct.weighted_levenshtein("mot", F.lit("capteur"), 2, 2, 2).alias("distance"))


# normalisation


@query(f"{_LEARNT}, {_LEMMA_SQL} SELECT mot, racine FROM dic UNION ALL SELECT mot, lemme FROM lem WHERE mot NOT IN (SELECT mot FROM dic) AND mot IN (SELECT token FROM toks)")
def learned_lemmas(spark, d):
    learned = metrics.vocabulary(zoned_archive(spark, d)).join(_lemmas(spark), "mot").select("mot", F.col("lemme").alias("racine"))
    path = f"{shared_dir(spark)}/appris-{uuid.uuid4().hex}"
    tables.write_tsv(tables.add_learned(spark.createDataFrame(_LEMMAS[:6], "mot string, racine string"), learned), path)
    return tables.read_tsv(spark, path, "mot string, racine string")


@query("SELECT fichier, array_to_string(list_transform(list_filter(regexp_extract_all(lower(texte), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '\\p{L}+')), lambda x: CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _LEMMAS) + " ELSE x END), ' ') AS lemmes FROM zoned")
def lemma_texts(spark, d):
    table = F.create_map(*[F.lit(x) for kv in _LEMMAS for x in kv])
    return archive(spark, d, ("fichier", "texte")).select("fichier", F.array_join(lemma_text(F.col("texte"), table), " ").alias("lemmes"))


@query()
def stem_vocab(spark, d):
    return stem_vocabulary(metrics.vocabulary(zoned_archive(spark, d)))


_ROOTS = "roots AS (SELECT DISTINCT token AS mot, left(token, 4) AS racine FROM toks)"


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return metrics.vocabulary(zoned_archive(spark, d)).withColumn("racine", F.substring("mot", 1, 4))


@query(f"{_ROOTS} SELECT racine, count(DISTINCT mot) AS mots FROM roots GROUP BY ALL")
def shared_roots(spark, d):
    return metrics.shared_roots(_roots(spark, d))


@query(f"{_ROOTS} SELECT racine, count(DISTINCT mot) AS mots FROM roots GROUP BY ALL ORDER BY mots DESC, racine LIMIT 10")
def most_shared_roots(spark, d):
    return metrics.shared_roots(_roots(spark, d)).orderBy(F.col("mots").desc(), "racine").limit(10)


@query(f"{_ROOTS}, k AS (SELECT racine, count(DISTINCT mot) AS mots FROM roots GROUP BY ALL) SELECT mots, count(*) AS racines, round(count(*) / (SELECT count(*) FROM k), 6) AS part FROM k GROUP BY mots")
def root_histogram(spark, d):
    return metrics.root_histogram(_roots(spark, d))


@query(f"{_ROOTS} SELECT count(*) AS mots, count(DISTINCT racine) AS racines, CAST(sum(CASE WHEN mot = racine THEN 1 ELSE 0 END) AS BIGINT) AS inchanges, round(1 - count(DISTINCT racine) / count(*), 6) AS reduction FROM roots")
def normalizer_stats(spark, d):
    return metrics.normalizer_stats(_roots(spark, d))


# the same of French stems, which DuckDB can't follow


@query()
def stem_shared_roots(spark, d):
    return metrics.shared_roots(stem_vocab(spark, d))


@query()
def stem_most_shared_roots(spark, d):
    return metrics.shared_roots(stem_vocab(spark, d)).orderBy(F.col("mots").desc(), "racine").limit(10)


@query()
def stem_root_histogram(spark, d):
    return metrics.root_histogram(stem_vocab(spark, d))


@query()
def stem_normalizer_stats(spark, d):
    return metrics.normalizer_stats(stem_vocab(spark, d))


# sources and sinks


@query("SELECT fichier, coalesce(strftime(date, '%Y-%m-%d'), '') AS jour, coalesce(nullif(trim(titre), ''), '') AS titre, coalesce(len(images), 0) AS n_images FROM docs")
def xml_round_trip(spark, d):
    path = f"{shared_dir(spark)}/xml-{uuid.uuid4().hex}"
    xml.write(archive(spark, d), path)
    back = xml.read(spark, path)
    return back.select("fichier", F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("jour"), F.coalesce("titre", F.lit("")).alias("titre"), F.size("images").cast("long").alias("n_images"))


@query("SELECT mot, '' AS remplacement FROM idfs WHERE round(idf, 6) <= 0.1")
def stoplist_file(spark, d):
    path = f"{shared_dir(spark)}/stops-{uuid.uuid4().hex}"
    tables.write_stop_list(metrics.stop_list(metrics.term_frequencies(zoned_archive(spark, d))), path)
    return tables.read_substitutions(spark, path)


@query("SELECT DISTINCT token, fichier FROM toks WHERE zone = 'titre'")
def wide_index_round_trip(spark, d):
    index = postings.postings(zoned_archive(spark, d, ("titre",)), ("titre",)).select("token", "fichier")
    path = f"{shared_dir(spark)}/large-{uuid.uuid4().hex}"
    tables.write_wide_index(index, path)
    return tables.read_wide_index(spark, path)


def _round_trip(spark: SparkSession, df: DataFrame, name: str, schema: str, header: bool = True) -> DataFrame:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    tables.write_tsv(df, path, header)
    return tables.read_tsv(spark, path, schema, header)


@query("SELECT fichier, zone, token, count(*) AS tf FROM toks GROUP BY ALL")
def segmentation_file(spark, d):
    return _round_trip(spark, metrics.zone_tokens(zoned_archive(spark, d)), "segments", "fichier string, zone string, token string, tf long", False)


@query("SELECT * FROM tf")
def tf_file(spark, d):
    return _round_trip(spark, metrics.term_frequencies(zoned_archive(spark, d)), "tf", "document_id string, mot string, tf long")


@query("SELECT mot, df, round(idf, 6) AS idf FROM idfs")
def idf_file(spark, d):
    return _round_trip(spark, metrics.idf(metrics.term_frequencies(zoned_archive(spark, d))), "idf", "mot string, df long, idf double")


@query("SELECT document_id, mot, round(tf * idf, 6) AS tf_idf FROM tf JOIN idfs USING (mot)")
def tfidf_file(spark, d):
    return _round_trip(spark, metrics.tf_idf(metrics.term_frequencies(zoned_archive(spark, d))), "tfidf", "document_id string, mot string, tf_idf double")


@query(_FREQ + " SELECT * FROM h WHERE champ IN ('titre', 'rubrique', 'images_legende') AND terme NOT LIKE '%\t%'")
def frequency_index_file(spark, d):
    path = f"{shared_dir(spark)}/frequences-{uuid.uuid4().hex}"
    docs = archive(spark, d)
    tables.write_frequency_index(postings.field_frequencies(docs).where("champ in ('titre', 'rubrique', 'images_legende') and not contains(terme, '\t')"), path)
    return tables.read_frequency_index(spark, path)


@query(f"{_LEMMA_SQL}, v AS (SELECT DISTINCT token AS mot FROM toks WHERE regexp_full_match(token, '\\p{{L}}+')) SELECT mot, coalesce(lemme, mot) AS lemme, left(mot, 4) AS racine FROM v LEFT JOIN lem USING (mot)")
def comparison_file(spark, d):
    words = metrics.vocabulary(zoned_archive(spark, d)).where(F.col("mot").rlike(r"^\p{L}+$"))
    path = f"{shared_dir(spark)}/comparaison-{uuid.uuid4().hex}"
    tables.write_comparison(words.withColumn("racine", F.substring("mot", 1, 4)), lemma_vocabulary(words, _lemmas(spark)), path)
    return tables.read_comparison(spark, path)


def _layout(docs: DataFrame) -> DataFrame:
    """Pages in the archive's layout, made of its articles: (fichier, html); names in several fragments, texts in paragraphs."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = [
        "<html><head><title>", F.coalesce(F.date_format("date", "yyyy/MM/dd"), F.lit("")), " bulletin</title></head><body><span class='style32'>BE ", F.regexp_extract(F.coalesce("numero", F.lit("")), "[0-9]+", 0),
        "</span><table><tr><td class='FWExtra2'><p class='style96'><span class='style42'>", safe(F.col("rubrique")), "</span><br><span class='style17'>", safe(F.col("titre")), "</span></p><p>", safe(F.col("texte")), "</p><p class='style93'>x</p></td></tr></table>",
        "<table><tr><td><span class='style28'>Rédacteur</span></td><td><p class='style44'>", safe(F.col("auteur")), " <b>CNRS</b><br>Paris</p></td></tr></table></body></html>",
    ]
    return docs.select("fichier", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("html"))


_FILED = [("11", "2011-04-05", "Focus", "Un capteur", "Il mesure."), ("12", "2012-10-31", "A lire", "Une pompe & un filtre", "Elle pompe. Il filtre."), ("13", None, "", "", "")]
_FILED_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _FILED)


@query(f"SELECT * FROM (VALUES {_FILED_SQL}) v(numero, jour, rubrique, titre, texte)")
def folder_scan(spark, d):
    """A folder of three page files, written one a task and read as the archive's own files are."""
    rows = spark.range(0, len(_FILED), 1, len(_FILED)).join(F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(_FILED)], "id long, numero string, jour string, rubrique string, titre string, texte string")), "id")
    pages = _layout(rows.select(F.col("numero").alias("fichier"), "numero", F.col("jour").cast("timestamp").alias("date"), "rubrique", "titre", F.lit(None).cast("string").alias("auteur"), "texte"))
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.select("html").write.text(path)
    back = html.read_folder(spark, until_exit(spark, path), glob="part-*")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return back.select("numero", F.date_format("date", "yyyy-MM-dd").alias("jour"), blank("rubrique"), blank("titre"), blank("texte"))


_FLAT = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


@query(f"SELECT fichier, nullif(regexp_extract(coalesce(numero, ''), '[0-9]+'), '') AS numero, strftime(date, '%Y-%m-%d') AS jour, {_FLAT.format('rubrique')} AS rubrique, {_FLAT.format('titre')} AS titre, {_FLAT.format('texte')} AS texte, trim({_FLAT.format('auteur')} || ' CNRS Paris') AS auteur FROM docs")
def bulletin_extract(spark, d):
    pages = _layout(archive(spark, d))
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")).alias(c)
    return html.extract(pages, "html", "fichier").select("fichier", "numero", F.date_format("date", "yyyy-MM-dd").alias("jour"), flat("rubrique"), flat("titre"), flat("texte"), flat("auteur"))


@query()
def pages_extract(spark, d):
    pages = spark.read.parquet(f"{d}/bulletins.parquet").where("texte is not null").select("fichier", "texte").distinct()
    return html.extract(pages, "texte", "fichier", html.page).select("fichier", "titre", "texte", F.size("images").alias("n_images"))


_RULES = [(f"{c} manquant", "erreur", f"{c} IS NULL OR trim(CAST({c} AS VARCHAR)) = ''") for c in ("numero", "date", "rubrique", "titre", "texte")] + [
    (f"image sans {n}", "avertissement", f"len(list_filter(images, lambda x: coalesce(x.{f} = '', true))) > 0") for n, f in (("url", "url"), ("legende", "legende"))
]


@query(" UNION ALL ".join(f"SELECT fichier, '{level}' AS niveau, '{name}' AS regle FROM docs WHERE {test}" for name, level, test in _RULES))
def quality_report(spark, d):
    return xml.quality_report(archive(spark, d))


# evaluation


@query(f"""found AS (SELECT 'capteur' AS requete, fichier FROM docs WHERE {_holds('capteur')} UNION ALL SELECT 'couche', fichier FROM docs WHERE {_holds('couche')}),
 truth AS (SELECT 'capteur' AS requete, fichier FROM docs WHERE {_holds('capteur', 'titre')} UNION ALL SELECT 'couche', fichier FROM docs WHERE {_holds('couche', 'titre')}),
 f AS (SELECT requete, count(*) AS n FROM found GROUP BY ALL), t AS (SELECT requete, count(*) AS v FROM truth GROUP BY ALL), h AS (SELECT requete, count(*) AS j FROM found JOIN truth USING (requete, fichier) GROUP BY ALL)
 SELECT requete, CASE WHEN v > 0 THEN round(coalesce(j, 0) / v, 6) ELSE 0.0 END AS rappel, CASE WHEN n > 0 THEN round(coalesce(j, 0) / n, 6) ELSE 0.0 END AS precision, coalesce(n, 0) AS taille FROM t FULL JOIN f USING (requete) LEFT JOIN h USING (requete)""")
def precision_recall(spark, d):
    index = search_index(spark, d)
    pick = lambda w, z: postings.matching(index, [w], zone=z).select(F.lit(w).alias("requete"), "fichier")
    return results.evaluate(pick("capteur", "texte").unionByName(pick("couche", "texte")), pick("capteur", "titre").unionByName(pick("couche", "titre")))


@query(f"""e AS (SELECT 'a' AS modele, count(*) AS n FROM docs WHERE {_holds('capteur')} UNION ALL SELECT 'a', count(*) FROM docs WHERE {_holds('couche')} UNION ALL SELECT 'b', count(*) FROM docs WHERE {_holds('pile')})
 SELECT modele, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS rappel, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision, round(avg(n), 6) AS taille FROM e GROUP BY modele""")
def means_by_model(spark, d):
    index = search_index(spark, d)
    asked = {"capteur": "a", "couche": "a", "pile": "b"}
    found = [postings.matching(index, [w]).select(F.lit(w).alias("requete"), "fichier") for w in asked]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    names = spark.createDataFrame(list(asked.items()), "requete string, modele string")
    each = names.join(results.evaluate(rows, rows), "requete", "left").na.fill(0)
    return results.means(each)

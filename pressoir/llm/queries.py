"""Queries of the problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import boilerplate, canonical, encodings, frequencies, lookalikes, markup, metrics, mixing, packing, stuffing

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.damaged_tokens(table(spark, d, "bulletins"), ["texte"], "fichier", "site").select(F.col("cle").alias("fichier")).distinct()


def p1_repares(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired_texts(table(spark, d, "bulletins"), ["texte", "titre"], "fichier", "site")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return metrics.most_distinctive(metrics.distinctiveness(table(spark, d, "token_metrics"), residuals=False))


def p2_residuals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distinctiveness(table(spark, d, "token_metrics"))


def p2_distinctifs(spark: SparkSession, d: str) -> DataFrame:
    """The choice of p2_found by the adjusted residual in place of tf x log10(N/df)."""
    scored = p2_residuals(spark, d).select("document_id", "mot", "df", "residual_ajuste")
    return metrics.most_distinctive(materialize(scored, "residuals"), "residual_ajuste")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.dirty_texts(lookalikes.written_texts(table(spark, d, "articles"), table(spark, d, "requetes")))


def p3_formes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_texts(lookalikes.written_texts(table(spark, d, "articles"), table(spark, d, "requetes")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    reference = table(spark, d, "rubriques_ref")
    mapped = canonical.map_rubrics(table(spark, d, "articles"), table(spark, d, "requetes"), reference)
    labels = reference.select(F.col("libelle").alias("valeur"))
    return mapped.join(labels, "valeur", "left_anti").select("champ", "cle", "pos", "rubric_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    mapped = canonical.map_rubrics(table(spark, d, "articles"), table(spark, d, "requetes"), table(spark, d, "rubriques_ref"))
    return mapped.where("rubric_id = 0").groupBy("champ", "valeur").agg(F.count("*").alias("lignes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.marked_fields(table(spark, d, "bulletins"), ["texte", "titre"])


def p5_propres(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_fields(table(spark, d, "bulletins"), ["texte", "titre"])


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.term_frequencies(table(spark, d, "token_metrics"), table(spark, d, "anti_dictionnaire"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequencies(spark, d).where("marque is not null").select("mot", "marque")


def p6_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every n-gram of one to three tokens of the queries' text, with its occurrences and the number of queries that hold it."""
    asked = table(spark, d, "requetes").select("query_id", "raw_query").distinct()
    return frequencies.gram_frequencies(frequencies.suffixes(asked, "query_id", "raw_query", 3), 3)


def p6_ngrams_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same of every length: the suffixes run to the end of the text."""
    asked = table(spark, d, "requetes").select("query_id", "raw_query").distinct()
    longest = frequencies.most_tokens(asked, "raw_query")
    return frequencies.gram_frequencies(frequencies.suffixes(asked, "query_id", "raw_query", longest), longest)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "bulletins"))


def p7_corps(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "bulletins"))


def p8_conteneurs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "contenants"))


def p8_bilan(spark: SparkSession, d: str) -> DataFrame:
    return packing.filling(p8_conteneurs(spark, d), table(spark, d, "contenants"))


def p9_tirage(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "melanges"))[0]


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "melanges"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents")).where("spam").select("doc_id").distinct()


def p10_mots(spark: SparkSession, d: str) -> DataFrame:
    """Words and links of every text, as the measures count them."""
    return p10_mesures(spark, d).select("doc_id", "mots", "liens")


def p10_mesures(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


#: The cleaned counts of token_metrics, as term_counts reads them.
_COUNTS = """
n AS (SELECT document_id, zone, lower(regexp_replace(mot, '^\\s+|\\s+$', '', 'g')) AS mot, coalesce(tf, 0) AS tf FROM token_metrics WHERE document_id IS NOT NULL AND mot IS NOT NULL),
z AS (SELECT document_id, zone, mot, max(tf) AS tf FROM n WHERE mot <> '' GROUP BY ALL),
c AS (SELECT document_id, mot, CAST(sum(tf) AS BIGINT) AS tf FROM z GROUP BY ALL),
t AS (SELECT mot, count(*) AS df, CAST(sum(tf) AS BIGINT) AS c FROM c GROUP BY ALL),
r AS (SELECT document_id, CAST(sum(tf) AS BIGINT) AS r FROM c GROUP BY ALL),
g AS (SELECT count(*) AS docs, CAST(sum(r) AS DOUBLE) AS n FROM r)
"""


def _p3_sql() -> str:
    """The characters and words of problem 3 by code points: look-alike letters beside Latin ones, but for one Greek letter before one or two Latin ones."""
    look = lookalikes
    hidden, foreign = f"[{look.IGNORABLES}{look.MARKS}{look.FORMS}\U0001d400-\U0001d7ff]", f"[{look.FOREIGN}]"
    inner = f"[\\p{{M}}{look.IGNORABLES}]*"
    symbol = "(^|[^\\p{L}\\p{M}])[α-ω]\\p{Latin}{1,2}($|[^\\p{L}\\p{M}])"
    parts = [hidden, f"[{look.SPACES}{look.HYPHENS}]", f"\\p{{Latin}}{inner}{foreign}", f"{foreign}{inner}\\p{{Latin}}", f"(^|[^\\p{{L}}\\p{{N}}]){foreign}[''’]\\p{{Latin}}"]
    test = f"regexp_matches(regexp_replace(t, '{symbol}', '\\1\\2', 'g'), '{'|'.join(parts)}')"
    rows = "SELECT 'texte' AS champ, fichier AS cle, texte AS t FROM articles UNION ALL SELECT 'content_terms', CAST(query_id AS VARCHAR), unnest(content_terms) FROM requetes"
    return f"SELECT DISTINCT champ, cle FROM ({rows}) WHERE {test}"


SQL: dict[str, str] = {
    "p3_found": _p3_sql(),
    "p10_mots": """WITH x AS (SELECT doc_id, len(regexp_extract_all(text, 'https?://\\S+|www\\.\\S+|\\]\\([^)\\s]*\\)')) AS liens, len(regexp_extract_all(text, 'https?://\\S+|www\\.\\S+|\\]\\([^)\\s]*\\)|[\\p{L}\\p{N}]+')) AS termes FROM documents)
        SELECT doc_id, coalesce(termes - liens, 0) AS mots, coalesce(liens, 0) AS liens FROM x""",
    "p2_residuals": f"""WITH {_COUNTS},
        x AS (SELECT document_id, mot, tf, df, round(tf * log10(docs / df), 6) + 0.0 AS tf_idf, r * c / n AS e, (1 - r / n) * (1 - c / n) AS v FROM c JOIN t USING (mot) JOIN r USING (document_id), g)
        SELECT document_id, mot, tf, df, tf_idf, round(e, 6) AS attendu, CASE WHEN e > 0 THEN round((tf - e) / sqrt(e), 6) END AS residual,
        CASE WHEN e > 0 AND v > 0 THEN round((tf - e) / sqrt(e) / sqrt(v), 6) END AS residual_ajuste FROM x""",
    "p2_found": f"""WITH {_COUNTS},
        x AS (SELECT document_id, mot, round(tf * log10(docs / df), 6) AS s FROM c JOIN t USING (mot), g WHERE df >= 2),
        b AS (SELECT document_id, max(s) AS s FROM x WHERE s > 0 GROUP BY ALL) SELECT document_id, mot FROM x JOIN b USING (document_id, s)""",
    "p2_distinctifs": f"""WITH {_COUNTS},
        e AS (SELECT document_id, mot, tf, r * c / n AS e, (1 - r / n) * (1 - c / n) AS v FROM c JOIN t USING (mot) JOIN r USING (document_id), g WHERE df >= 2),
        x AS (SELECT document_id, mot, CASE WHEN e > 0 AND v > 0 THEN round((tf - e) / sqrt(e) / sqrt(v), 6) END AS s FROM e),
        b AS (SELECT document_id, max(s) AS s FROM x WHERE s > 0 GROUP BY ALL) SELECT document_id, mot FROM x JOIN b USING (document_id, s)""",
    "p6_frequencies": f"""WITH {_COUNTS},
        s AS (SELECT DISTINCT lower(regexp_replace(mot, '^\\s+|\\s+$', '', 'g')) AS mot FROM anti_dictionnaire WHERE mot IS NOT NULL),
        f AS (SELECT mot, coalesce(c, 0) AS occurrences, coalesce(df, 0) AS articles FROM t FULL JOIN (SELECT * FROM s WHERE mot <> '') USING (mot)),
        m AS (SELECT mot, occurrences, articles, list_filter([CASE WHEN articles < 3 THEN 'rare' END, CASE WHEN articles > 0.5 * docs THEN 'commun' END], lambda x: x IS NOT NULL) AS k FROM f, g)
        SELECT mot, occurrences, articles, unnest(CASE WHEN len(k) = 0 THEN [NULL] ELSE k END) AS marque FROM m""",
    "p6_found": f"""WITH {_COUNTS},
        s AS (SELECT DISTINCT lower(regexp_replace(mot, '^\\s+|\\s+$', '', 'g')) AS mot FROM anti_dictionnaire WHERE mot IS NOT NULL),
        f AS (SELECT mot, coalesce(df, 0) AS articles FROM t FULL JOIN (SELECT * FROM s WHERE mot <> '') USING (mot))
        SELECT mot, 'rare' AS marque FROM f WHERE articles < 3 UNION SELECT mot, 'commun' FROM f, g WHERE articles > 0.5 * docs""",
    "p6_ngrams": """WITH q AS (SELECT DISTINCT query_id, raw_query FROM requetes WHERE query_id IS NOT NULL AND raw_query IS NOT NULL),
        w AS (SELECT row_number() OVER () AS rn, query_id, regexp_extract_all(lower(raw_query), '[\\p{L}\\p{N}_]+') AS t FROM q),
        p AS (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM w),
        k AS (SELECT query_id, t, i, unnest([1, 2, 3]) AS n FROM p),
        x AS (SELECT query_id, n, array_to_string(t[i:i + n - 1], ' ') AS gram FROM k WHERE i + n - 1 <= len(t))
        SELECT gram, n, count(*) AS occurrences, count(DISTINCT query_id) AS records FROM x GROUP BY ALL""",
    "p6_ngrams_whole": """WITH q AS (SELECT DISTINCT query_id, raw_query FROM requetes WHERE query_id IS NOT NULL AND raw_query IS NOT NULL),
        w AS (SELECT query_id, regexp_extract_all(lower(raw_query), '[\\p{L}\\p{N}_]+') AS t FROM q),
        p AS (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM w),
        k AS (SELECT query_id, t, i, unnest(range(1, len(t) - i + 2)) AS n FROM p),
        x AS (SELECT query_id, CAST(n AS INT) AS n, array_to_string(t[i:i + n - 1], ' ') AS gram FROM k)
        SELECT gram, n, count(*) AS occurrences, count(DISTINCT query_id) AS records FROM x GROUP BY ALL""",
}

QUERIES: dict[str, Query] = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}

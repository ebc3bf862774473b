"""The engine on a hand-made archive."""

import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressoir.functions import text as T
from pressoir.functions.stem import stem
from pressoir.operators import correct, metrics, postings, results
from pressoir.plans import boolean, compile
from pressoir.plans.ir import StructuredQuery
from pressoir.schema import COLUMNS, DOCUMENT, check_keys, latest, zones
from pressoir.session import hash_sample, join_margin, spread


def row(f, date, rubrique, titre, texte, images):
    return (f, "1", date, rubrique, titre, None, None, texte, images)


ROWS = [
    row("d1.htm", datetime(2012, 5, 31), "Focus", "énergie solaire", "panneaux solaires et batteries", [("u.jpg", "vue")]),
    row("d1b.htm", datetime(2012, 5, 31), "Focus", "énergie solaire", "panneaux solaires et batteries", [("u.jpg", "vue")]),
    row("d2.htm", datetime(2012, 6, 15), "Focus", "batteries", "recherche sur les batteries, l'eau et l'air", []),
    row("d3.htm", datetime(2013, 1, 1), "Evénement", "l'eau", "m² d'eau, 3½ litres", [("", None)]),
    row("d4.htm", None, "A lire", "solaire", "panneaux", None),
    row("d5.htm", datetime(2013, 12, 31), None, "air", "air air AIR", [("a.jpg", None), (None, "b")]),
    row("d6.htm", datetime(2014, 2, 1), "Actualité-Innovation", None, "", []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENT).cache()


def ids(df):
    return sorted(r["fichier"] for r in df.collect())


def find(docs, **c):
    return ids(compile.select(docs, postings.postings(docs), StructuredQuery(**c), folded=c.pop("folded", False) if "folded" in c else False))


def test_counts(docs):
    tf = metrics.term_frequencies(docs)
    assert {(r.document_id, r.mot): r.tf for r in tf.collect()}["d5.htm", "air"] == 4
    assert metrics.size(tf).first().n == 6  # d6 holds no token
    assert {r.mot: r.df for r in metrics.idf(tf).collect()}["eau"] == 2
    assert "3½" in {r.mot for r in tf.collect()} and "m²" in {r.mot for r in tf.collect()}


def test_term_of_every_document_has_no_idf(spark):
    d = spark.createDataFrame([row("a", None, None, "x", "x y", None), row("b", None, None, "x", None, None)], DOCUMENT)
    assert {r.mot: r.idf for r in metrics.idf(metrics.term_frequencies(d)).collect()}["x"] == 0.0
    assert [r.mot for r in metrics.stop_list(metrics.term_frequencies(d)).collect()] == ["x"]


def test_empty_archive(spark):
    d = spark.createDataFrame([], DOCUMENT)
    assert metrics.tf_idf(metrics.term_frequencies(d)).count() == 0
    assert find(d, content_terms=("eau",)) == []


def test_terms(docs):
    assert find(docs, content_terms=("eau",)) == ["d2.htm", "d3.htm"]
    assert find(docs, content_terms=("eau", "air"), content_operator="AND") == ["d2.htm"]
    assert find(docs, content_terms=("eau", "panneaux"), content_operator="OR") == ["d1.htm", "d1b.htm", "d2.htm", "d3.htm", "d4.htm"]
    assert find(docs, content_terms=("panneaux solaires",)) == ["d1.htm", "d1b.htm"]
    assert ids(compile.select(docs, postings.postings(docs), StructuredQuery(content_terms=("panneaux solaires",)), strict=True)) == []
    assert find(docs, content_terms=("inconnu",)) == []
    assert find(docs, title_terms=("solaire",)) == ["d1.htm", "d1b.htm", "d4.htm"]
    assert find(docs, negated_content_terms=("eau air", "panneaux")) == ["d3.htm", "d5.htm", "d6.htm"]


def test_null_logic(docs):
    assert find(docs, rubric_terms=("focus",)) == ["d1.htm", "d1b.htm", "d2.htm"]
    assert "d5.htm" in find(docs, negated_rubric_terms=("focus",)) and "d1.htm" not in find(docs, negated_rubric_terms=("focus",))
    assert find(docs, rubric_terms=("événement",)) == []  # accents count
    assert ids(compile.select(docs, None, StructuredQuery(rubric_terms=("événement",)), folded=True)) == ["d3.htm"]
    assert find(docs, has_image=True) == ["d1.htm", "d1b.htm", "d5.htm"]
    assert "d4.htm" not in find(docs, date_start=datetime(2000, 1, 1)) and "d4.htm" not in find(docs, date_end=datetime(2100, 1, 1))
    assert find(docs, excluded_periods=("2012", "x")) == ["d3.htm", "d4.htm", "d5.htm", "d6.htm"]


def test_order_and_rubrics(docs):
    got = [r.fichier for r in compile.search(docs, postings.postings(docs), StructuredQuery()).collect()]
    assert got == ["d6.htm", "d5.htm", "d3.htm", "d2.htm", "d1.htm", "d1b.htm", "d4.htm"]
    assert [r.rubrique for r in compile.search(docs, postings.postings(docs), StructuredQuery(target="rubriques")).collect()] == ["A lire", "Actualité-Innovation", "Evénement", "Focus"]
    for name in ("recent", "ancien", "pertinence", "naturel"):
        assert docs.withColumn("score", F.lit(0.0)).orderBy(*results.ordering(name)).count() == 7


def test_boolean_condition(docs):
    z = docs.select("fichier", "date", "rubrique").join(zones(docs), "fichier")
    assert ids(z.where(boolean.condition(boolean.parse("(eau ou panneaux) et pas titre:solaire depuis 2012")))) == ["d2.htm", "d3.htm"]


def test_keys_and_latest(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), ("b", None, "w")], "fichier string, recu_le int, v string")
    assert {(r.probleme, r.fichier) for r in check_keys(d).collect()} == {("cle nulle", None), ("cle repetee", "a")}
    assert {(r.fichier, r.v) for r in latest(d).collect()} == {("a", "y"), (None, "z"), ("b", "w")}


def test_postings_rekey_and_lots(spark, docs):
    index = postings.postings(docs, ("texte",))
    roots = spark.createDataFrame([("batteries", "batterie"), ("eau", "eau"), ("air", "eau")], "mot string, racine string")
    assert postings.rekey(index, roots).where("token = 'eau' and fichier = 'd2.htm'").count() == 1
    lines = {r.token: r.documents for r in postings.inverted_index(docs, ("texte",)).collect()}
    assert lines["batteries"] == "d1.htm d1b.htm d2.htm"
    old, postings.LOT = postings.LOT, 2
    try:
        cut = [r for r in postings.inverted_index(docs, ("texte",)).collect() if r.token == "batteries"]
        assert sorted(x for r in cut for x in r.documents.split()) == ["d1.htm", "d1b.htm", "d2.htm"]
    finally:
        postings.LOT = old


def test_field_frequencies(docs):
    f = {(r.champ, r.terme, r.document_id): r.tf for r in postings.field_frequencies(docs).collect()}
    assert f["rubrique", "focus", "d1.htm"] == 1 and f["titre_texte", "air", "d5.htm"] == 4 and f["images_url", "u.jpg", "d1.htm"] == 1 and ("images_url", "", "d3.htm") not in f


TEXTS = ["L'été à la mer", "l’eau", "C'est-à-dire : 3½ m² d'eau !", "", "  A  B ", "AÉRO_nef (2)"]


def test_text_functions_agree_with_python(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r for r in d.select("i", T.tokens("t").alias("tok"), T.standardize("t").alias("std"), T.standardize("t", inert_apostrophe=True).alias("inert"), T.standardize("t", curly=True).alias("curly")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].tok == re.findall(r"\w+", t.lower())
        assert got[i].std == re.sub(r"[^\w\s]", "", t.strip().lower().replace("'", " "))
        assert got[i].inert == re.sub(r"[^\w\s]", "", t.strip().lower())
    assert got[1].curly == "l eau"


def test_substitute_and_highlight(spark):
    d = spark.createDataFrame([("L'Été, été!",), (None,)], "t string")
    table = F.create_map(F.lit("été"), F.lit("hiver"))
    assert [r[0] for r in d.select(T.substitute("t", table)).collect()] == ["L'hiver, hiver!", None]
    assert d.select(T.highlight("t", ["été", "("])).first()[0] == "L'**Été**, **été**!"
    assert d.select(T.highlight("t", [])).first()[0] == "L'Été, été!"


def test_apply_filter(docs):
    got = T.apply_filter(docs, ["titre", "images.legende", "date", "absent"], F.upper).where("fichier = 'd1.htm'").first()
    assert got.titre == "ÉNERGIE SOLAIRE" and got["images"][0].legende == "VUE" and got["images"][0].url == "u.jpg"


def test_dates(spark):
    d = spark.createDataFrame([("03/05/2012",), ("2012-05-03",), ("31/02/2012",), (None,)], "t string")
    assert [str(r[0]) for r in d.select(T.slash_date("t")).collect()] == ["2012-05-03", "None", "None", "None"]


def test_snippets():
    text = "x" * 100 + " Eau douce " + "y" * 200 + " eau salée"
    got = results.snippet_list(text, ["eau"])
    assert len(got) == 2 and "**Eau**" in got[0] and got[0].startswith("... ") and got[0].endswith(" ...") and not got[1].endswith(" ...")
    assert results.snippet_list("abc", [""]) == [] and results.snippet_list(None, ["a"]) == [] and results.snippet_list("a a", ["a"]) == ["**a** **a**"]


def test_scores_and_evaluation(spark, docs):
    assert {r.fichier: r.score for r in results.naive_scores(docs, ["air"]).collect()} == {"d2.htm": 1.0, "d5.htm": 13.0}
    found = spark.createDataFrame([("q", "a"), ("q", "b")], "requete string, fichier string")
    truth = spark.createDataFrame([("q", "a"), ("r", "c")], "requete string, fichier string")
    got = {r.requete: (r.rappel, r.precision, r.taille) for r in results.evaluate(found, truth).collect()}
    assert got == {"q": (1.0, 0.5, 2), "r": (0.0, 0.0, 0)}
    assert results.means(results.evaluate(found, truth).withColumn("modele", F.lit("m"))).first().rappel == 0.5


LEXICON = ["sante", "santes", "sentir", "energie", "energies"]


def test_correction(spark):
    lex = spark.createDataFrame([(w,) for w in LEXICON], "mot string")
    words = spark.createDataFrame([(w,) for w in ["santte", "energ", "xyz", "sante", "sa", None, "santte"]], "mot string")
    got = {r.mot: (r.correction, r.methode) for r in correct.correct_tokens(words, lex).collect()}
    assert got == {"santte": ("sante", "LEV(1)"), "energ": ("energie", "LEV(2)"), "xyz": (None, "NON TROUVÉ"), "sante": ("sante", "DIRECT"), "sa": (None, "NON TROUVÉ")}
    assert {r.mot: r.correction for r in correct.longest_prefix(words, lex).collect()}["energ"] == "energie"
    with pytest.raises(ValueError):
        correct.prefix_candidates(words, lex, proximity=0)
    said = correct.correct_sentences(spark.createDataFrame([(1, "Sante, xyz")], "k int, t string"), lex, "k", "t").orderBy("pos").collect()
    assert [(r.piece, r.methode) for r in said] == [("sante", "DIRECT"), (",", "SYMBOLE"), ("xyz", "NON TROUVÉ")]


def test_block_join_equals_all_pairs(spark):
    words = ["capteur", "capture", "cap", "captif", "carte", "ca", "batterie", "battu", "bat"]
    w = spark.createDataFrame([(x,) for x in words], "mot string")
    got = {(r.mot, r.candidat, r.score) for r in correct.prefix_candidates(w, w).collect()}
    want = set()
    for a in words:
        for b in words:
            if min(len(a), len(b)) >= 3 and abs(len(a) - len(b)) <= 4:
                lcp = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                if (s := 100 * lcp // max(len(a), len(b))) >= 60:
                    want.add((a, b, s))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_weighted_distance_is_symmetric_at_unit_cost(a, b):
    assert correct.weighted_distance(a, b) == correct.weighted_distance(b, a)
    assert abs(len(a) - len(b)) <= correct.weighted_distance(a, b) <= max(len(a), len(b))


STEMS = {"continuait": "continu", "continuellement": "continuel", "majestueusement": "majestu", "majorité": "major", "malade": "malad", "rapidement": "rapid", "nationaux": "national", "chevaux": "cheval", "technologies": "technolog", "évidemment": "évident", "maïs": "maï", "lectures": "lectur"}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_roots(spark):
    roots = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "c")], "mot string, racine string")
    s = metrics.normalizer_stats(roots).first()
    assert (s.mots, s.racines, s.inchanges, s.reduction) == (3, 2, 1, 0.333333)
    assert {(r.mots, r.racines, r.part) for r in metrics.root_histogram(roots).collect()} == {(1, 1, 0.5), (2, 1, 0.5)}


def test_join_margin_with_hot_key(spark):
    left = spark.createDataFrame([("hot",)] * 900 + [(f"k{i}",) for i in range(100)], "k string")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = join_margin(left, right, "k", F.col("n"), 1000)
    assert got.count() == 1000 and got.where("k = 'hot'").first().n == 900


def test_set_algebra_of_results(docs):
    both = set(find(docs, content_terms=("eau", "air"), content_operator="AND"))
    either = set(find(docs, content_terms=("eau", "air"), content_operator="OR"))
    assert both <= either and not either & set(find(docs, content_terms=("eau", "air"), content_operator="OR", negated_content_terms=("eau", "air")))


def test_columns():
    assert COLUMNS == ["fichier", "numero", "date", "rubrique", "titre", "auteur", "contact", "texte", "images"]


def test_hash_sample_keeps_distinct_values(spark):
    d = spark.createDataFrame([("hot",)] * 300 + [(f"v{i}",) for i in range(50)] + [(None,)], "t string")
    few, all_ = hash_sample(d, "t", 10), hash_sample(d, "t", 1000)
    assert few.count() == 10 and all_.count() == 51 and {r.t for r in few.collect()} <= {r.t for r in all_.collect()}
    assert hash_sample(d.limit(0), "t", 5).count() == 0
    assert [r.t for r in hash_sample(d.union(d), "t", 10).collect()] == [r.t for r in few.collect()]


def test_spread_only_scans_of_few_partitions(spark):
    d = spark.range(100).coalesce(1)
    assert spread(d).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism and spread(d.repartition(50)).rdd.getNumPartitions() == 50

"""Written indexes, query terms, costs of edits, pages of results, deliveries and bulletins."""

from datetime import datetime

from pyspark.sql import functions as F

from pressoir.functions.stem import lemma_text
from pressoir.operators import correct, postings, results
from pressoir.plans import compile
from pressoir.plans.ir import StructuredQuery
from pressoir.schema import latest, read_zones
from pressoir.session import join_margin
from pressoir.sources import html, tables

POSTINGS = [(z, t, f"d{i}") for z in ("texte", "titre") for t, n in (("eau", 40), ("air", 3), ("feu", 1)) for i in range(n)]


def test_written_index(spark, tmp_path):
    index = spark.createDataFrame(POSTINGS, "zone string, token string, fichier string")
    tables.write_postings(index, str(tmp_path / "index"))
    back = tables.read_postings(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, back.collect())) == sorted(POSTINGS)
    plan = postings.matching(back, ["eau", "air"], "AND")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan and "In(token, [air,eau])" in plan
    assert sorted(r.fichier for r in postings.matching(back, ["eau", "air"], "AND").collect()) == ["d0", "d1", "d2"]


def test_zones_fall_back(spark):
    index = spark.createDataFrame(POSTINGS, "zone string, token string, fichier string")
    docs = spark.createDataFrame([("d0", None), ("d2", None), ("d9", None)], "fichier string, date timestamp")
    asked = StructuredQuery(content_terms=("air",))
    ids = lambda **k: sorted(r.fichier for r in compile.select(docs, index, asked, **k).collect())
    assert ids() == ids(content=("content", "texte")) == ["d0", "d2"] and ids(content=("content",)) == []
    assert compile.select(docs, index.limit(0), asked, content=("content", "texte")).count() == 0


def test_query_terms(spark):
    words = spark.createDataFrame([("Capteurs",), ("captuers",), ("mesures",), ("zzz",), (None,), (" ",), ("Capteurs",)], "terme string")
    dictionary = spark.createDataFrame([("capteurs", "capteur"), ("capteurs", "z")], "mot string, racine string")
    lexicon = spark.createDataFrame([("capteurs",), ("mesures",)], "mot string")
    lemmas = spark.createDataFrame([("mesures", "mesure")], "mot string, lemme string")
    got = {r.terme: (r.racine, r.voie) for r in correct.normalize_terms(words, dictionary, lexicon, lemmas).collect()}
    assert got == {"Capteurs": ("capteur", "DICTIONNAIRE"), "captuers": ("captuers", "INCONNU"), "mesures": ("mesure", "LEMME"), "zzz": ("zzz", "INCONNU")}
    near = spark.createDataFrame([("capteurr",)], "terme string")
    assert [tuple(r) for r in correct.normalize_terms(near, dictionary, lexicon, lemmas).collect()] == [("capteurr", "capteur", "CORRIGE")]
    assert correct.normalize_terms(words.limit(0), dictionary, lexicon, lemmas).count() == 0


def test_weighted_distances(spark):
    pairs = [("eau", "eaux"), ("eaux", "eau"), ("chat", "chien"), ("", "ab"), (None, "a"), ("été", "ete")]
    d = spark.createDataFrame(pairs, "a string, b string")
    for costs in ((1, 1, 1), (2, 2, 2), (1, 2, 3), (0.5, 1, 1)):
        got = [r[0] for r in d.select(correct.weighted_levenshtein("a", "b", *costs)).collect()]
        assert got == [None if a is None else correct.weighted_distance(a, b, *costs) for a, b in pairs]
    assert correct.weighted_distance("eau", "eaux", insert=5) == 5 and correct.weighted_distance("eaux", "eau", delete=7) == 7


def test_blocks_lose_no_candidate(spark):
    words = ["cap", "capt", "capteur", "capteurs", "capturer", "capital", "ca", "cat", "captation", "éolienne", "éoliennes"]
    d = spark.createDataFrame([(w,) for w in words], "mot string")
    got = {(r.mot, r.candidat): r.score for r in correct.prefix_candidates(d, d).collect()}

    def score(a, b):
        if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 4:
            return 0
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return 100 * n // max(len(a), len(b))

    assert got == {(a, b): score(a, b) for a in words for b in words if score(a, b) >= 60}


def test_pages_are_in_order(spark):
    rows = [("a", datetime(2012, 1, 1), "2", 1.0), ("b", None, "1", 3.0), ("c", datetime(2013, 1, 1), "1", 3.0), ("d", datetime(2012, 1, 1), "1", 2.0)]
    d = spark.createDataFrame(rows, "fichier string, date timestamp, numero string, score double")
    page = lambda name, size=9: [r.fichier for r in sorted(results.first_page(d, name, size).collect(), key=lambda r: r.rang)]
    assert page("recent") == ["c", "a", "d", "b"] and page("ancien") == ["a", "d", "c", "b"] and page("pertinence") == ["b", "c", "d", "a"]
    assert page("naturel") == ["a", "d", "b", "c"] and page("recent", 2) == ["c", "a"]


def test_ties_of_deliveries(spark):
    rows = [("a", 1, "1", "x"), ("a", 2, "1", "y"), ("a", 2, "2", "b"), ("b", None, "1", "w"), ("b", None, "1", "w"), ("c", 3, None, "v"), (None, 1, "1", "n")]
    d = spark.createDataFrame(rows, "fichier string, recu_le int, numero string, texte string")
    assert {(r.fichier, r.texte) for r in latest(d).collect()} == {("a", "b"), ("b", "w"), ("c", "v"), (None, "n")}
    slim = latest(d, columns=["texte"])
    assert slim.columns == ["fichier", "recu_le", "texte"] and {r.texte for r in slim.collect()} == {"b", "w", "v", "n"} and latest(d.limit(0)).count() == 0


def test_unwanted_zones_are_not_read(spark):
    d = spark.createDataFrame([("a", "t", None)], "fichier string, titre string, texte string")
    assert [tuple(r) for r in read_zones(d, ("titre",)).collect()] == [("a", "titre", "t")] and read_zones(d, ()).count() == 0
    assert read_zones(d.select("fichier", "titre"), ("titre",)).count() == 1  # other columns need not be there


def test_left_join_by_margins(spark):
    left = spark.createDataFrame([("hot", 1)] * 900 + [(f"k{i}", 1) for i in range(100)], "k string, j int")
    right = spark.createDataFrame([("hot", 1, 900), ("k1", 1, 1)], "k string, j int, n int")
    got = join_margin(left, right, ["k", "j"], F.col("n"), 1000, "left")
    assert got.count() == 1000 and got.where("n is null").count() == 99


def test_lemma_of_a_text(spark):
    d = spark.createDataFrame([("Les capteurs, 3 mesures.",), (None,)], "t string")
    table = F.create_map(F.lit("capteurs"), F.lit("capteur"))
    assert [r[0] for r in d.select(lemma_text(F.col("t"), table)).collect()] == [["les", "capteur", "mesures"], []]


PAGE = """<html><head><title>2012/05/31 x</title></head><body><span class="style32">BE 12</span>
<table><tr><td class="FWExtra2"><p class="style96"><span class="style42">Focus</span><br><span class="style17">Un titre</span></p><p>Un <b>mot</b> ici</p>
<p class="style96"><span class="style42">Autre</span> <span class="style17">rappel</span></p><p>Fin.</p></td></tr></table>
<div style="text-align: center"><img src=" u.jpg "><span class="style21">vue</span></div>
<table><tr><td><span class="style28">Rédacteur</span></td><td><p class="style44">Jean <b>Dupont</b><br>CNRS</p></td></tr></table></body></html>"""


def test_bulletin_of_several_fragments():
    got = html.bulletin(PAGE, "/x/1.htm")
    assert got["auteur"] == "Jean Dupont CNRS" and got["images"] == [{"url": "u.jpg", "legende": "vue"}]
    assert got["texte"].split() == "Un mot ici Fin.".split() and (got["titre"], got["rubrique"], got["numero"]) == ("Un titre", "Focus", "12")

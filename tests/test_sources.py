"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from pressoir.operators import postings
from pressoir.schema import DOCUMENT
from pressoir.sources import html, tables, xml
from pressoir.streaming.ingest import ingest

PAGE = """<html><title>2012/5/3 BE</title><span class="style32">BE 247 (8)</span><p class="style96"><span class="style42">rien</span></p>
<table><tr><td class="FWExtra2"><p class="style96"><span class="style42">Focus</span><br><span class="style17">L'&eacute;t&eacute;</span></p><p>Un <b>texte</b><p> </p><p class="style93">non</p><p>Deux&nbsp;mots</p></td></tr></table>
<div style="text-align: center"><img src="a.jpg"><span class="style21">vue</span></div><div style="text-align: center"><img src="b.jpg"></div>
<table><tr><td><span class="style28">R&eacute;dacteurs :</span></td><td><p class="style44">M. X</p></td></tr><tr><td><span class="style28">Pour en savoir plus, contacts :</span></td></tr></table>"""


def test_bulletin():
    d = html.bulletin(PAGE, "x/y/a.htm")
    assert (d["fichier"], d["numero"], str(d["date"])[:10], d["rubrique"], d["titre"], d["texte"]) == ("a.htm", "247", "2012-05-03", "Focus", "L'été", "Un texte\nDeux\xa0mots")
    assert d["images"] == [{"url": "a.jpg", "legende": "vue"}] and d["auteur"] == "M. X" and d["contact"] is None
    assert [i["url"] for i in html.bulletin(PAGE, "a", all_images=True)["images"]] == ["a.jpg", "b.jpg"]


@pytest.mark.parametrize("text", ["", "<p>", "</td></table>", "<title>2012/13/45</title>", "<td class=FWExtra2><p>a<p>b", "x" * 200_000, "<b>" * 3_000])
def test_bulletin_survives(text):
    assert html.bulletin(text, "f")["fichier"] == "f" and html.page(text, "f")["fichier"] == "f"


def test_folder_and_limit(spark, tmp_path):
    for n in ("b.htm", "a.htm", "c.txt"):
        (tmp_path / n).write_text(PAGE, encoding="utf-8")
    assert sorted(r.fichier for r in html.read_folder(spark, str(tmp_path)).collect()) == ["a.htm", "b.htm"]
    assert [r.fichier for r in html.read_folder(spark, str(tmp_path), 1).collect()] == ["a.htm"]
    assert html.read_folder(spark, str(tmp_path), 0).count() == 2
    assert html.read_file(spark, str(tmp_path / "a.htm")).schema == DOCUMENT
    q = ingest(spark, str(tmp_path), str(tmp_path / "t"), str(tmp_path / "k"))
    q.awaitTermination()
    ingest(spark, str(tmp_path), str(tmp_path / "t"), str(tmp_path / "k")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_xml_round_trip(spark, tmp_path):
    rows = [("a", "1", None, None, "t & <u>", None, None, "deux\nlignes", [("u", None), ("v", "w")]), ("b", None, None, "", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENT).withColumn("date", F.lit("2012-05-03").cast("timestamp"))
    xml.write(docs, str(tmp_path / "x"), {"fichier": "nom"})
    got = {r.fichier: r for r in xml.read(spark, str(tmp_path / "x"), {"fichier": "nom"}).collect()}
    assert got["a"].titre == "t & <u>" and got["a"].texte == "deux\nlignes" and str(got["a"].date)[:10] == "2012-05-03" and [tuple(i) for i in got["a"]["images"]] == [("u", None), ("v", "w")]
    assert got["b"].rubrique is None and got["b"]["images"] == []


def test_quality_report(spark):
    d = spark.createDataFrame([("a", "1", "3/5/2012", "r", "t", "x", [("", "l")]), ("b", "1", "03/05/2012", "r", " ", "x", None)], "fichier string, numero string, date string, rubrique string, titre string, texte string, images array<struct<url:string,legende:string>>")
    assert {(r.fichier, r.regle) for r in xml.quality_report(d).collect()} == {("a", "date mal formee"), ("a", "image sans url"), ("b", "titre manquant")}


def test_tables(spark, tmp_path):
    stops = spark.createDataFrame([("de", ""), ("nan", ""), ("null", "")], "mot string, remplacement string")
    tables.write_stop_list(stops, str(tmp_path / "s"))
    assert sorted((r.mot, r.remplacement) for r in tables.read_substitutions(spark, str(tmp_path / "s")).collect()) == [("de", ""), ("nan", ""), ("null", "")]
    index = spark.createDataFrame([("eau", f"d{i}") for i in range(700)] + [("na", "x"), ("eau", "d1")], "token string, fichier string")
    tables.write_wide_index(index, str(tmp_path / "w"), width=64)
    assert {tuple(r) for r in tables.read_wide_index(spark, str(tmp_path / "w")).collect()} == {tuple(r) for r in index.collect()}
    long = index.withColumn("zone", F.lit("texte"))
    tables.write_postings(long.distinct(), str(tmp_path / "p"))
    assert postings.matching(spark.read.parquet(str(tmp_path / "p")), ["eau", "na"], "OR").count() == 701
    learned = tables.add_learned(spark.createDataFrame([("a", "x")], "mot string, racine string"), spark.createDataFrame([("a", "y"), ("b", "z")], "mot string, racine string"))
    assert {tuple(r) for r in learned.collect()} == {("a", "x"), ("b", "z")}


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "search_and_date" in e.queries()

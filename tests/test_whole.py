"""Queries that do the whole job where SQL can follow a part only, against brute force on a hand-made archive."""

import re
from collections import Counter
from datetime import datetime

import pytest

from pressoir import queries
from pressoir.functions.stem import stem
from pressoir.schema import DOCUMENT

ROWS = [
    ("d1.htm", "énergie durable", "La gêne des réseaux, les matériaux et l'énergétique.", [("u.jpg", "éolienne marine")]),
    ("d2.htm", "réseau", "Le réseau énergivore ; des génomes, un matériel, 2012.", [(None, "éoliennes")]),
    ("d3.htm", "gene et genes", "Nationalité, nationaux, national ; chevaux, cheval.", None),
]
ASKED = ["Énergies du réseeau ?", "matériau gène éoliene", "energie, genome ou réseaux 2013", "nation été zzz", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("archive"))
    rows = [(f, "1", datetime(2012, 5, i + 1), "Focus", titre, None, None, texte, images) for i, (f, titre, texte, images) in enumerate(ROWS)]
    articles = spark.createDataFrame(rows, DOCUMENT).withColumnRenamed("date", "date_pub").selectExpr("*", "date_pub AS recu_le")
    articles.write.parquet(f"{d}/articles.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "query_id long, raw_query string").write.parquet(f"{d}/requetes.parquet")
    return d


def words(*texts):
    return {w for t in texts if t for w in re.findall(r"\w+", t.lower())}


LEXICON = words(*[t for _, titre, texte, images in ROWS for t in (titre, texte, *[x[1] for x in images or []])])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def candidates(a):
    out = {b: 100 * shared(a, b) // max(len(a), len(b)) for b in LEXICON if min(len(a), len(b)) >= 3 and abs(len(a) - len(b)) <= 4}
    return {b: s for b, s in out.items() if s >= 60}


def corrected(a):
    if a in LEXICON:
        return a, "DIRECT"
    found = candidates(a)
    if not found:
        return None, "NON TROUVÉ"
    best = min(found, key=lambda b: (distance(a, b), -found[b], b))
    return best, "PREFIXE" if len(found) == 1 else f"LEV({distance(a, best)})"


def test_correction_of_every_word(spark, folder):
    asked = words(*ASKED)
    got = {r.mot: (r.correction, r.methode) for r in queries.correct_tokens_whole(spark, folder).collect()}
    assert got == {w: corrected(w) for w in asked}
    assert got["énergies"][0] == "énergie" and got["réseaux"] == ("réseaux", "DIRECT") and got["éoliene"][0] == "éolienne"
    pairs = {(r.mot, r.candidat, r.score) for r in queries.prefix_candidates_whole(spark, folder).collect()}
    assert pairs == {(w, b, s) for w in asked - LEXICON for b, s in candidates(w).items()}
    longest = {r.mot: (r.correction, r.prefixe) for r in queries.longest_prefix_whole(spark, folder).collect()}
    want = {}
    for w in asked:
        if near := [b for b in LEXICON if shared(w, b) >= 3]:
            best = min(near, key=lambda b: (-shared(w, b), distance(w, b), b))
            want[w] = best, shared(w, best)
    assert longest == want


def test_sentences_are_corrected_by_every_zone(spark, folder):
    got = {(r.query_id, r.piece): (r.correction, r.methode) for r in queries.correct_sentences(spark, folder).collect()}
    assert {k: v for k, v in got.items() if v[1] != "SYMBOLE"} == {(i, w): corrected(w) for i, t in enumerate(ASKED) for w in words(t)}


def test_statistics_of_stems(spark, folder):
    root = {w: stem(w) for w in LEXICON if w.isalpha()}
    shared_by = Counter(root.values())
    assert max(len(r) for r in root.values()) > 4 and max(shared_by.values()) > 1
    assert {r.racine: r.mots for r in queries.stem_shared_roots(spark, folder).collect()} == shared_by
    most = [(r.racine, r.mots) for r in queries.stem_most_shared_roots(spark, folder).collect()]
    assert most == sorted(shared_by.items(), key=lambda x: (-x[1], x[0]))[:10]
    counts = Counter(shared_by.values())
    assert {(r.mots, r.racines, r.part) for r in queries.stem_root_histogram(spark, folder).collect()} == {(k, v, round(v / len(shared_by), 6)) for k, v in counts.items()}
    stats = queries.stem_normalizer_stats(spark, folder).first()
    assert tuple(stats) == (len(root), len(shared_by), sum(w == r for w, r in root.items()), round(1 - len(shared_by) / len(root), 6))

"""Operators over tables of counts, values and sizes: problems 2, 4, 6, 8, 9."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressoir.llm import canonical, frequencies, metrics, mixing, packing, queries
from pressoir.llm.tokens import FOLDER, VOCABULARY, encoding

COUNTS = "document_id string, zone string, mot string, tf long, tf_idf double"
ROWS = [("a", "t", " Eau", 2, None), ("a", "t", "eau", 2, 1.0), ("a", "x", "eau", 1, None), ("a", "t", "air", 1, None), ("b", "t", "air", 3, None), ("b", "t", "feu", 1, None), ("c", "t", "feu", 2, None), ("c", "t", "sol", 9, None), (None, "t", "eau", 5, None), ("c", "t", None, 5, None), ("c", "t", "  ", 5, None), ("b", None, "vent", None, None)]
CLASH = ("df", "c", "r", "n", "k", "valeur", "jeton", "place", "source_", "record", "suffix", "entree", "tas")


def clash(df):
    """The table with extra columns of the operators' own names."""
    return df.select("*", *[F.lit("z").alias(c) for c in CLASH if c not in df.columns])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_distinctiveness_against_plain_arithmetic(spark):
    df = spark.createDataFrame(ROWS, COUNTS)
    tf = Counter({("a", "eau"): 3, ("a", "air"): 1, ("b", "air"): 3, ("b", "feu"): 1, ("c", "feu"): 2, ("c", "sol"): 9, ("b", "vent"): 0})
    n = sum(tf.values())
    r, c, d = Counter(), Counter(), Counter()
    for (doc, mot), k in tf.items():
        r[doc] += k
        c[mot] += k
        d[mot] += 1
    got = {(x.document_id, x.mot): x for x in metrics.distinctiveness(clash(df)).collect()}
    assert set(got) == set(tf)
    for (doc, mot), k in tf.items():
        e = r[doc] * c[mot] / n
        assert got[doc, mot].tf == k and got[doc, mot].df == d[mot] and got[doc, mot].tf_idf == round(k * math.log10(3 / d[mot]), 6)
        if e:
            res = (k - e) / math.sqrt(e)
            assert got[doc, mot].residual == pytest.approx(res, abs=1e-5)
            assert got[doc, mot].residual_ajuste == pytest.approx(res / math.sqrt((1 - r[doc] / n) * (1 - c[mot] / n)), abs=1e-4)
        else:
            assert got[doc, mot].residual is None


def test_most_distinctive_ties_and_repeats(spark):
    df = spark.createDataFrame([("a", "t", "x", 1, None), ("a", "t", "y", 1, None), ("b", "t", "x", 1, None), ("b", "t", "y", 1, None), ("c", "t", "z", 1, None), ("a", "t", "x", 1, None)], COUNTS)
    assert rows(metrics.most_distinctive(metrics.distinctiveness(df))) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert metrics.most_distinctive(metrics.distinctiveness(df.limit(0))).count() == 0


def test_residuals_choose_terms(spark, tmp_path):
    """A term in few records, most of it in another one: tf-idf takes it, the residuals take the term that is more than expected."""
    tf = {("a", "eau"): 4, ("a", "air"): 3, ("b", "eau"): 40, ("c", "air"): 1, ("d", "air"): 1, ("d", "sel"): 2, ("e", "sel"): 2, ("f", "or"): 5}
    spark.createDataFrame([(doc, "t", mot, k, None) for (doc, mot), k in tf.items()], COUNTS).write.parquet(f"{tmp_path}/token_metrics.parquet")
    n = sum(tf.values())
    r, c, d = Counter(), Counter(), Counter()
    for (doc, mot), k in tf.items():
        r[doc], c[mot], d[mot] = r[doc] + k, c[mot] + k, d[mot] + 1
    best = defaultdict(list)
    for (doc, mot), k in tf.items():
        e = r[doc] * c[mot] / n
        if d[mot] > 1 and k > e:
            best[doc].append(((k - e) / math.sqrt(e * (1 - r[doc] / n) * (1 - c[mot] / n)), mot))
    got = rows(queries.p2_distinctifs(spark, str(tmp_path)))
    assert got == sorted((doc, max(of)[1]) for doc, of in best.items())
    assert ("a", "air") in got and ("a", "eau") not in got and ("a", "eau") in rows(queries.p2_found(spark, str(tmp_path)))


def test_hot_term_and_hot_record(spark):
    df = spark.createDataFrame([(f"d{i}", "t", "hot", 1, None) for i in range(600)] + [("d0", "t", f"m{i}", 1, None) for i in range(600)] + [("d1", "t", "m1", 1, None)], COUNTS)
    got = metrics.distinctiveness(df)
    assert got.count() == 1201 and got.where("mot = 'hot'").count() == 600
    assert ("d1", "m1") in rows(metrics.most_distinctive(got))


def test_term_frequencies(spark):
    stop = spark.createDataFrame([("Eau ",), ("ledit",), (None,), ("",)], "mot string")
    got = {r.mot: (r.occurrences, r.articles, r.marque) for r in frequencies.term_frequencies(clash(spark.createDataFrame(ROWS, COUNTS)), stop).collect()}
    assert got == {"eau": (3, 1, "rare"), "air": (4, 2, "rare"), "feu": (3, 2, "rare"), "sol": (9, 1, "rare"), "vent": (0, 1, "rare"), "ledit": (0, 0, "rare")} | {m: got[m] for m in ("air", "feu")}
    both = rows(frequencies.term_frequencies(spark.createDataFrame(ROWS, COUNTS)).where("mot = 'air'").select("marque"))
    assert both == [("commun",), ("rare",)]
    empty = spark.createDataFrame([], COUNTS)
    assert rows(frequencies.term_frequencies(empty, stop).select("mot", "marque")) == [("eau", "rare"), ("ledit", "rare")]
    assert frequencies.term_frequencies(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_ngrams_against_brute_force(spark, parts):
    texts = [(1, "a b a b a b"), (2, "a b c"), (3, "b b b b"), (4, None), (5, ""), (6, "a b c"), (None, "a b")] + [(10 + i, "le le le a") for i in range(9)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = clash(spark.createDataFrame(texts, "cle int, texte string"))
        got = {(r.gram, r.n): (r.occurrences, r.records) for r in frequencies.gram_frequencies(frequencies.suffixes(df, "cle", "texte", 3), 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    occ, rec = Counter(), defaultdict(set)
    for k, t in texts:
        ws = (t or "").split() if k is not None else []
        for n in (1, 2, 3):
            for i in range(len(ws) - n + 1):
                occ[" ".join(ws[i : i + n]), n] += 1
                rec[" ".join(ws[i : i + n]), n].add(k)
    assert got == {g: (occ[g], len(rec[g])) for g in occ}


LABELS = [(1, "Santé publique"), (2, "Génie civil"), (3, "Pêche et aquaculture"), (4, "Revue de presse"), (5, "Génie rural")]
SAID = {"SANTE PUBLIQUE": 1, "Santé pubilque": 1, "publique santé": 1, "SantéPublique": 1, "la rubrique Génie civil": 2, "génie c.": 2, "G3nie civil": 2, "PEA": 3, "Pêches/aquacultures": 3, "Revuede presse": 4, "horoscope": 0, "qsdfgh": 0, "  ": None, "Génie rura1": 5}


def test_mapping(spark):
    ref = spark.createDataFrame(LABELS, "rubric_id int, libelle string")
    articles = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate([*SAID, None, "Santé publique"])] + [("f0", "SANTE PUBLIQUE")], "fichier string, rubrique string")
    asked = spark.createDataFrame([(7, ["Génie civil", None, "revue presse", ""]), (8, None), (9, [])], "query_id long, rubric_terms array<string>")
    got = {(r.champ, r.cle, r.pos): (r.valeur, r.rubric_id) for r in canonical.map_rubrics(clash(articles), clash(asked), ref).collect()}
    assert {v: i for v, i in got.values() if v in SAID} == {v: i for v, i in SAID.items() if i is not None}
    assert got["rubric_terms", "7", 2] == ("revue presse", 4) and got["rubric_terms", "7", 0][1] == 2 and len(got) == len(SAID) - 1 + 1 + 2
    assert canonical.map_rubrics(articles.limit(0), asked.limit(0), ref).count() == 0
    assert {r.rubric_id for r in canonical.map_rubrics(articles, asked, ref.limit(0)).collect()} == {0}


def test_long_lists(spark, monkeypatch):
    """A list of some thousand entries: candidates come by repaired tokens; without repair misspelt values are lost."""
    rng = random.Random(12)
    syllables = [a + b for a in "bcdfglmnprstv" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(3, 5)))
    labels = sorted({f"{word()} {word()}" for _ in range(3_000)}) + [f"commune {word()}" for _ in range(500)]
    ref = spark.createDataFrame(list(enumerate(labels, 1)), "rubric_id int, libelle string")
    wrong = {}
    for i in rng.sample(range(len(labels)), 60):
        typed = []
        for w in labels[i].split():
            k = rng.randrange(1, len(w) - 1)
            typed.append(f"{w[:k]}x{w[k + 1 :]}")
        wrong[" ".join(reversed(typed))] = i + 1
    values = spark.createDataFrame([(v,) for v in wrong], "valeur string")
    got = {r.valeur: r.entree for r in canonical.map_values(values, ref).collect()}
    assert sum(got[v] == i for v, i in wrong.items()) >= 57
    monkeypatch.setattr(canonical, "allowed", lambda _: 0)
    monkeypatch.setattr(canonical, "value_keys", lambda *_: [])
    bare = {r.valeur: r.entree for r in canonical.map_values(values, ref).collect()}
    assert sum(bare[v] == i for v, i in wrong.items()) <= 30


def test_common_tokens_lead_to_no_candidates():
    common, rare = ("energie", 1.0, 0.5), ("solaire", 1.0, 4.0)
    assert canonical.leading_words(["energie", "solaire"], {"energie": [common], "solaire": [rare]}) == ["solaire"]
    assert canonical.leading_words(["energie"], {"energie": [common]}) == ["energie"]
    assert canonical.leading_words(["de", "xyz"], {}) == []


def test_long_value(spark):
    ref = canonical.Reference(LABELS)
    assert canonical.rank(ref, canonical.tokens_of("x" * 20_000), {})[0] == 0


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_against_full_table(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                m[i][j] = i + j
                continue
            m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                m[i][j] = min(m[i][j], m[i - 2][j - 2] + 1)
    assert canonical.osa(a, b, 20) == m[-1][-1]
    assert canonical.osa(a, b, 1) == min(m[-1][-1], 2)
    if m[-1][-1] <= 2:
        assert canonical.deletions(a, 2) & canonical.deletions(b, 2)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120), st.integers(1, 50))
def test_packing_holds_every_item_once(lengths, capacity):
    histogram = Counter(min(n, capacity) for n in lengths)
    events, count = packing.pack_histogram(dict(histogram), capacity)
    fill, placed = Counter(), Counter()
    for length, a, b, first in events:
        placed[length] += b - a
        for r in range(a, b):
            fill[0 if length == 0 else first + r - a] += length
    assert placed == histogram and all(v <= capacity for v in fill.values()) and len([v for v in fill.values() if v]) <= count
    total = sum(k * v for k, v in histogram.items())
    assert count <= 2 * -(-total // capacity) + 1


def test_pack(spark):
    texts = [(i, "mot " * n) for i, n in enumerate([3, 3, 3, 10, 60, 0, 1, 1, 500])] + [(3, "mot " * 10), (None, "un deux"), (99, None)]
    docs = clash(spark.createDataFrame(texts, "doc_id long, text string"))
    kinds = spark.createDataFrame([(1, 16), (2, 64), (3, None), (4, 0)], "contenant_id int, capacite_tokens int")
    got = packing.pack(docs, kinds).collect()
    enc = encoding(FOLDER, VOCABULARY)
    want = Counter({(c, k): 0 for c in (1, 2) for k, _ in texts})
    for k, t in texts:
        for c in (1, 2):
            want[c, k] += len(enc.encode_ordinary(t or ""))
    have = Counter()
    fill = Counter()
    for r in got:
        have[r.contenant_id, r.doc_id] += r.jetons
        fill[r.contenant_id, r.conteneur] += r.jetons
    assert {k: v for k, v in have.items()} == dict(want) and all(v <= (16 if c == 1 else 64) for (c, _), v in fill.items())
    whole = [r for r in got if r.contenant_id == 2 and r.doc_id == 4]
    assert len(whole) == -(-want[2, 4] // 64)
    assert packing.pack(docs.limit(0), kinds).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, spark.createDataFrame([(1, 2_000_000)], "contenant_id int, capacite_tokens int"))


def test_mix(spark):
    docs = spark.createDataFrame([(i, "mot " * (i % 7 + 1), "grand") for i in range(2000)] + [(5000 + i, "mot " * 5, "petit") for i in range(40)] + [(9000, "x", None), (9001, None, "petit"), (9002, "", "petit")], "doc_id long, text string, source string")
    mixes = spark.createDataFrame([(1, "grand", 3.0, 1), (1, "petit", 1.0, 4), (2, "petit", 0.5, None), (2, "absent", 0.5, 2), (3, "petit", None, 1), (3, "grand", -1.0, 1), (None, "petit", 1.0, 1), (4, "grand", 1.0, 0)], "melange_id int, source string, poids_cible double, repetitions_max int")
    drawn, report = mixing.mix(clash(docs), mixes)
    got = {(r.melange_id, r.source): r for r in report.collect()}
    assert got[1, "grand"].part_reelle == pytest.approx(0.75, abs=0.01) and got[1, "petit"].repetitions <= 4 and got[1, "grand"].repetitions == 1
    assert got[2, "absent"].jetons == 0 and got[2, "absent"].part_cible == 0.5 and got[2, "petit"].part_reelle == 1.0
    assert got[3, "petit"].jetons == 0 and got[4, "grand"].jetons == 0
    d = drawn.collect()
    assert all(r.repetitions <= 4 for r in d if r.source == "petit" and r.melange_id == 1) and len({(r.melange_id, r.doc_id) for r in d}) == len(d)
    sums = Counter()
    for r in d:
        sums[r.melange_id, r.source] += r.jetons * r.repetitions
    assert all(got[k].jetons == v for k, v in sums.items())
    assert mixing.mix(docs.limit(0), mixes)[0].count() == 0 and mixing.mix(docs, mixes.limit(0))[1].count() == 0


def test_thresholds_are_nested_and_near(spark):
    rows_ = [(i, "s", 1 + i % 5) for i in range(3000)]
    docs = spark.createDataFrame(rows_, "k long, source string, n long").withColumn("place", mixing.place(F.col("k"), 17))
    t = mixing.thresholds(docs, {(1, "s"): 100, (2, "s"): 5000})
    for m, budget in ((1, 100), (2, 5000)):
        got = docs.where(F.col("place") < t[m, "s"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        assert abs(got - budget) <= 3
    assert t[1, "s"] < t[2, "s"]

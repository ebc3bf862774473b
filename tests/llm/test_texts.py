"""Operators over texts: problems 1, 3, 5, 7, 10."""

import random

import pytest
from pyspark.sql import functions as F

from pressoir.llm import boilerplate, encodings, lookalikes, markup, stuffing
from pressoir.llm.stuffing import stuffing as measure

NOUNS = "capteur batterie molécule système réseau filtre océan forêt énergie chaleur béton fusée marée éolienne dépôt".split()


def sentence(rng):
    a, b = rng.sample(NOUNS, 2)
    return rng.choice([f"Le {a} a été présenté à côté du {b}, où la même équipe l'a déjà étudié.", f"Les essais menés près de l'entrepôt montrent que le {a} résiste à la {b}.", f"Après une première année, le {a} coûte moins que prévu ; c'est très léger."])


def article(rng, n=6):
    return "\n".join(" ".join(sentence(rng) for _ in range(2)) for _ in range(n))


def clash(df):
    return df.select("*", *[F.lit("z").alias(c) for c in ("cle", "champ", "jeton", "n", "tas", "mot", "m", "contenu", "post", "prior") if c not in df.columns])


PAGES = "fichier string, site string, titre string, texte string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


# problem 1


@pytest.mark.parametrize("written,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "cp1252")])
def test_undo_is_an_exact_round_trip(written, read):
    text = "été où naïve cœur ça À É".replace("œ", "oe") if written in ("cp850",) else "été où ça À É"
    garbled = text.encode(written).decode(read, "replace")
    if "�" not in garbled:
        steps = [(read, written)]
        assert encodings.undo(garbled, steps) == text


def test_damaged_pages(spark):
    rng = random.Random(4)
    rows = [(f"c{i}", f"s{i % 3}", None, article(rng)) for i in range(60)]
    bad = {}
    for i, (w, r) in enumerate([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1252", "mac_roman"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("utf-8", "cp850")]):
        text = article(rng).replace("’", "'")
        bad[f"b{i}"] = text
        rows.append((f"b{i}", "s0", None, text.encode(w, "ignore").decode(r, "replace")))
    rows += [("perdu", None, None, "caract�re perdu"), ("majuscules", "s1", None, "L'ÉCOLE À ÉTÉ ÎLE DE LA GÂTINE SÃO PAULO"), ("russe", "s1", None, "Le groupe «Зарница» étudie ├── l'été ©"), ("nul", "s1", None, None), ("vide", "s1", None, ""), ("c0", "s0", None, rows[0][3])]
    df = clash(pages(spark, rows))
    got = encodings.damaged_tokens(df, ["texte"], "fichier", "site").select(F.col("cle")).distinct()
    assert {r[0] for r in got.collect()} == {*bad, "perdu"}
    mended = {r.cle: r.texte_repare for r in encodings.repaired_texts(df, ["texte", "titre"], "fichier", "site").collect()}
    for k in ("b0", "b1", "b3", "b5"):
        same = sum(a == b for a, b in zip(mended[k].split(), bad[k].split())) / len(bad[k].split())
        assert same > 0.97, (k, same)


def test_damaged_empty_and_long(spark):
    assert encodings.damaged_tokens(pages(spark, []), ["texte"], "fichier", "site").count() == 0
    assert encodings.damaged_tokens(pages(spark, [("a", "s", None, "déjà " * 100_000)]), ["texte"], "fichier", "site").count() == 0


def test_sources_settle_ambiguous_tokens():
    """The same weak evidence under the priors of three sources: read by two of them, each in its own way, and left alone in the third."""
    mac, dos = encodings.NAMES.index("mac<cp1252"), encodings.NAMES.index("cp850<cp1252")
    token = {"jeton": "Vˆl", "n": 1, "lectures": [{"chaine": mac, "lecture": "Vàl", "gain": 0.0}, {"chaine": dos, "lecture": "Vêl", "gain": 0.0}]}

    def read(**shares):
        prior = [0.05 / len(encodings.CHAINS)] * len(encodings.CHAINS)
        for i, x in shares.items():
            prior[{"mac": mac, "dos": dos}[i]] = x
        return [t["lecture"] for t in encodings.settle_record([token], prior, 1)]

    assert read(mac=0.6) == ["Vàl"] and read(dos=0.6) == ["Vêl"] and read() == []


# problem 3

SAME = {"Le cοnsοrtium": "Le consortium", "ｌ’ｅａｕ": "l’eau", "coeﬃcient": "coefficient", "été": "été", "tech\u200bnique": "technique", "l\u00a0eau": "l eau", "Haut‑Val": "Haut-Val", "роrеuѕе": "poreuse", "ѕ'est": "s'est"}
KEPT = ["α-synucléine", "λ vaut 2 Ω", "mot φως", "«Заря»", "l’été — “oui” … œuf ² ½ CO₂ €", "μm", "νe", "plain"]


def test_table_forms():
    assert lookalikes.matches(list(SAME)) == list(SAME.values())
    assert lookalikes.matches(KEPT) == KEPT
    assert lookalikes.matches(lookalikes.matches(list(SAME))) == list(SAME.values())


def test_trie_finds_the_common_spelling():
    t = lookalikes.Trie()
    for w, n in (("vent", 5), ("nent", 1), ("vents", 9)):
        t.add(w, n)
    assert t.match(lookalikes.readings("νent")) == "vent"
    assert t.match(list("vant")) is None and t.match(list("vant"), 1.0) == "vent"


def test_dirty_texts(spark):
    articles = spark.createDataFrame([("a", "le consortium robuste"), ("b", "Le cοnsοrtium rоbuste"), ("c", "inсоnnu"), ("d", None), ("e", ""), ("f", KEPT[4]), ("g", "deux\u2003mots"), ("b", "Le cοnsοrtium rоbuste"), ("h", "x " * 200_000)], "fichier string, texte string")
    asked = spark.createDataFrame([(1, ["eau", None, "rоbuste"]), (2, None), (3, []), (4, ["α-synucléine"])], "query_id long, content_terms array<string>")
    texts = lookalikes.written_texts(clash(articles.withColumn("n", F.lit(1))), clash(asked))
    assert sorted(map(tuple, lookalikes.dirty_texts(texts).collect())) == [("content_terms", "1"), ("texte", "b"), ("texte", "c"), ("texte", "g")]
    forms = {(r.cle, r.pos): r.forme for r in lookalikes.consistent_texts(texts).collect()}
    assert forms["b", 0] == "Le consortium robuste" and forms["c", 0] == "inconnu" and forms["g", 0] == "deux mots" and forms["1", 2] == "robuste" and forms["f", 0] == KEPT[4]
    ways = {r.mot: r.voie for r in lookalikes.canonical_words(texts).collect()}
    assert ways["rоbuste"] == "lexique" and ways["inсоnnu"] == "table"
    assert lookalikes.dirty_texts(texts.limit(0)).count() == 0


def test_the_trie_decides(spark):
    """Letters without a look-alike are found, and look-alikes of two letters spelled, by the vocabulary alone."""
    rows = [("a", "une bonne énergie, un niveau de gaz de 3 kΩ"), ("b", "une boνne éηergie"), ("c", "kΩ μm Δt ΔT éηη"), ("d", "inηonnu")]
    texts = lookalikes.written_texts(spark.createDataFrame(rows, "fichier string, texte string"), spark.createDataFrame([], "query_id long, content_terms array<string>"))
    assert {r.mot: (r.forme, r.voie) for r in lookalikes.canonical_words(texts).collect()} == {"boνne": ("bonne", "lexique"), "éηergie": ("énergie", "lexique")}
    assert [r.cle for r in lookalikes.dirty_texts(texts).collect()] == ["b"]
    assert {r.cle: r.forme for r in lookalikes.consistent_texts(texts).collect()}["b"] == "une bonne énergie"
    t = lookalikes.Trie()
    t.add("énergie", 3)
    assert t.match(lookalikes.readings("éηergie"), lookalikes.UNKNOWN_COST) == "énergie" and t.match(lookalikes.readings("éηergie")) is None
    assert lookalikes.by_table("boνne") == "bovne" and lookalikes.by_table("éηergie") == "éηergie"


# problem 5


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    return markup.train([sentence(rng) for _ in range(300)] + ["Un titre court", "Méthode"])


def test_field_on_held_out_pages(field):
    rng = random.Random(3)
    right = total = 0
    for lines, want in markup.labelled_pages([sentence(rng) for _ in range(300)], 80, seed=77):
        for (_, y), w in zip(markup.labels_of("\n".join(lines), field), want):
            right += (y > 0) == (w > 0)
            total += 1
    assert right / total > 0.97


def test_gradient_is_that_of_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(1)
    f = markup.Field(3, 2)
    f.w, f.t = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    x, y = rng.normal(size=(4, 3)), np.array([0, 1, 1, 0])

    def ll():
        s = x @ f.w
        path = lambda z: sum(s[i, z[i]] for i in range(4)) + sum(f.t[z[i - 1], z[i]] for i in range(1, 4))
        every = [path([(k >> i) & 1 for i in range(4)]) for k in range(16)]
        return path(y) - np.log(np.exp(every).sum())

    gw, gt = f.gradient(x, y)
    for m, g in ((f.w, gw), (f.t, gt)):
        for at in np.ndindex(m.shape):
            m[at] += 1e-6
            up = ll()
            m[at] -= 2e-6
            down = ll()
            m[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4
    best = max(range(16), key=lambda k: sum((x @ f.w)[i, (k >> i) & 1] for i in range(4)) + sum(f.t[(k >> (i - 1)) & 1, (k >> i) & 1] for i in range(1, 4)))
    assert list(f.decode(x)) == [(best >> i) & 1 for i in range(4)]


MARKED = ["Un <b>mot</b> gras", "l'&eacute;t&eacute;", "**gras** ici", "[[lien]] ici", "un ''mot''", "\\section{Titre}", "## Titre", "cit\\'e", "<p>Un paragraphe sans fin", "texte&nbsp;"]
PLAIN = ["if (a < b && c > d) return t[i] * 2;", "p < 0,05 et un rapport > 3", "C:\\donnees\\brutes\\essai", "Écrire à <redaction@site.example>", "La R&D et l'atelier C#", "– une pompe", "    x = lire(3)", "12 $ et 40 $ [prix relevés]", "", None]


def test_marked_or_plain(field):
    assert [t for t in MARKED if not markup.has_markup(t, field)] == []
    assert [t for t in PLAIN if markup.has_markup(t, field)] == []


def test_the_field_decides(field):
    flat = markup.Field(len(markup.NAMES), len(markup.LABELS))
    assert not any(markup.has_markup(t, flat) for t in MARKED)
    # the same line reads as code or as text by its neighbours
    code = "x = lire(3)"
    assert markup.labels_of(f"```\n{code}\n```", field)[1][1] == markup.LABELS.index("code") and markup.labels_of(code, field)[0][1] == 0
    under = "Un titre\n========"
    assert [markup.LABELS[y] for _, y in markup.labels_of(under, field)] == ["titre", "titre"]


def test_clean(field):
    text = "<h2>Titre</h2>\n<p>Un <b>mot</b> &eacute;crit</p>\n<ul>\n<li>un</li>\n<li>deux</li>\n</ul>\n<pre><code>\nx = lire(3)\nif x &lt; 3:\n    alerte(x)\n</code></pre>\nFin."
    assert markup.clean(text, field) == "# Titre\nUn mot écrit\n- un\n- deux\n```\nx = lire(3)\nif x < 3:\n    alerte(x)\n```\nFin."
    assert markup.clean(None, field) is None and markup.clean("", field) == ""
    assert markup.clean("C'est \\`a Paris, \\og cit\\'e\\fg{}~\\cite{x}.", field) == "C'est à Paris, « cité »."


def test_marked_fields(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", "s", "Un titre", article(rng)) for i in range(20)] + [("m", "s", "# Titre", "Un <em>mot</em>\n" + article(rng)), ("n", None, None, None), ("m", "s", "# Titre", None), ("v", "s", "", ""), ("l", "s", "t", "mot " * 100_000)]
    df = clash(pages(spark, rows))
    assert sorted(map(tuple, markup.marked_fields(df, ["texte", "titre"]).collect())) == [("m", "texte"), ("m", "titre")]
    assert markup.marked_fields(df.limit(0), ["texte", "titre"]).count() == 0
    assert markup.clean_fields(df, ["titre"]).where("propre is null").count() == 1


# problem 7

FRAME = ["Accueil - Régions - Boutique - Contact", "Se connecter", "Cette page dépose des cookies de statistiques."]
FOOT = ["Les plus lus", "1. Vers la fin du radar", "2. Un projet de turbine", "Sur le même thème", "Le radar au secours du verre", "Mentions légales", "© 2012 Journal - Tous droits réservés"]
MENU = ["Accueil", "Régions", "Boutique", "Contact", "Vidéos", "Agenda"]


def framed(rng, i):
    """A page whose mark-up tells frame from article, as the model learns from."""
    wrap = lambda t: rng.choice([f'<div class="nav">{t}</div>', f'<li><a href="/{i}">{t}</a></li>', f"<td>{t}</td>"])
    top = [" - ".join(rng.sample(MENU, 4)), rng.choice(FRAME[1:])]
    foot = ["Les plus lus", *[f"{k + 1}. Vers la fin du {rng.choice(NOUNS)}" for k in range(2)], "Sur le même thème", f"Le {rng.choice(NOUNS)} au secours du verre", "Mentions légales", f"© {2000 + i} Journal - Tous droits réservés"]
    body = [f"<p>{t}</p>" for t in article(rng, 4).split("\n")]
    return "\n".join([*map(wrap, top), *body[:2], f"<h2>{rng.choice(['Méthode', 'Limites'])}</h2>", *body[2:], *map(wrap, foot)])


def test_frame_lines(spark):
    rng = random.Random(6)
    body = article(rng).split("\n")
    body[2:2] = ["Méthode", "– une pompe durable", "E = k × v²", "Les cookies des sites marchands ont servi de matière à cette étude de l'université, dit le rapport."]
    page = "\n".join([*FRAME, "", *body, *FOOT])
    start = len(FRAME) + 1 + len(body)
    want = [0, 1, 2, *range(start, start + len(FOOT))]
    rows = [("a", "s", None, page), ("a", "s", None, page), ("n", "s", None, None), ("v", "s", None, "\n \n"), ("w", "s", None, ""), ("t", "s", None, article(rng)), ("l", "s", None, "\n".join([sentence(rng)] * 5_000)), ("m", "s", None, "\n".join([*FRAME, *FOOT]))]
    rows += [(f"h{i}", "s", None, framed(rng, i)) for i in range(60)]
    got = {}
    for r in boilerplate.boilerplate_lines(clash(pages(spark, rows))).collect():
        got.setdefault(r.fichier, []).append(r.ligne)
    assert sorted(got.pop("a")) == want
    assert len(got.pop("m")) == len(FRAME) + len(FOOT)
    assert {k: sorted(v) for k, v in got.items()} == {f"h{i}": [0, 1, *range(7, 14)] for i in range(60)}
    bodies = {r.fichier: r.corps for r in boilerplate.main_text(pages(spark, rows)).collect()}
    assert bodies["a"] == "\n".join(body)
    assert boilerplate.boilerplate_lines(pages(spark, rows).limit(0)).count() == 0


def test_density_decides_the_lines(monkeypatch):
    rng = random.Random(7)
    samples = [framed(rng, i) for i in range(60)]
    links = boilerplate.link_model_of(samples)
    plain = ["\n".join([*FRAME, *article(rng).split("\n"), *FOOT]) for _ in range(20)]
    got = [set(boilerplate.frame_lines(p, links)) for p in plain]
    assert sum(len(x) for x in got) >= 19 * (len(FRAME) + len(FOOT))
    unlearnt = [set(boilerplate.frame_lines(p, boilerplate.Links({}, -1.0))) for p in plain]
    assert sum(len(a ^ b) for a, b in zip(got, unlearnt)) > sum(map(len, got)) / 2
    monkeypatch.setattr(boilerplate, "density", lambda *_: 1.0)
    flat = [set(boilerplate.frame_lines(p, links)) for p in plain]
    assert sum(len(a ^ b) for a, b in zip(got, flat)) > sum(map(len, got)) / 2


def test_densities():
    assert boilerplate.density(0, 1, 0, 0, 0.1) == 0.0
    assert boilerplate.density(100, 1, 100, 1, 0.3) == 0.0 < boilerplate.density(100, 1, 60, 0.6, 0.3) < boilerplate.density(100, 1, 5, 0.05, 0.3)
    assert boilerplate.density(400, 2, 0, 0, 0.1) > boilerplate.density(400, 8, 0, 0, 0.1)


# problem 10

SPAM = [
    "\n".join(f"pompe pas cher ville{i}" for i in range(20)), " ".join(f"https://a.test/{i} pompe" for i in range(20)), "Tags : " + " / ".join(["pompe cheap", "filtre", "radar deal", "verre"] * 6),
    " ".join(["Vous cherchez pompe ? Nos pompe sont les pompe qu'il vous faut : pompe, soldes, pompe."] * 6), "\n".join(f"Réf. {i:04d} pompe fine – {i},99 € – promo" for i in range(20)),
    "\n".join(f"* [pompe devis gratuit](https://a.test/{i})" for i in range(10)),
]


def test_stuffing():
    rng = random.Random(8)
    fair = [article(rng), article(rng) + "\n[1] A. B, qui décrit la pompe dans la Revue, texte en ligne : https://a.test/1\nTags : eau, air", " ".join(["Ob sich das Verfahren durchsetzt, hängt größtenteils von den Kosten ab."] * 5),
            "\n".join("Tourne, pompe, tourne encore,\nLa mer s'endort près du port,\net la ville attend l'aurore." for _ in range(4)), "", None, " \n"]
    assert [measure(t)["bourrage"] > stuffing.LEAST_STUFFED for t in SPAM] == [True] * len(SPAM)
    assert [measure(t)["bourrage"] > stuffing.LEAST_STUFFED for t in fair] == [False] * len(fair)


def test_autocorrelation():
    import numpy as np

    assert stuffing.autocorrelation(np.array([1, 2, 3] * 10)) == (1.0, 3)
    assert stuffing.autocorrelation(np.arange(50))[0] == 0.0 and stuffing.autocorrelation(np.array([], dtype="int64")) == (0.0, 0)


def test_stuffed_pages(spark):
    df = clash(spark.createDataFrame([(1, SPAM[0]), (1, SPAM[0]), (2, None), (3, ""), (None, "La mer est belle et le ciel aussi."), (4, "mot " * 50_000)], "doc_id long, text string"))
    got = stuffing.stuffed_pages(df)
    assert got.count() == 6 and sorted({r.doc_id for r in got.where("spam").collect()}) == [1, 4]
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


CYCLE = "pompe à chaleur neuve, filtre à charbon actif, radar de recul fiable, verre de lampe solaire, moteur de portail coulissant, clavier de tablette tactile, serrure à code étanche"


def test_long_periods_are_stuffed():
    import numpy as np

    rng = np.random.default_rng(5)
    assert stuffing.autocorrelation(np.array(list(range(60)) * 8)) == (1.0, 60)
    for terms in (rng.integers(-1, 6, 300), rng.integers(-3, 90, 500), np.array([1] * 700 + [-1] * 40), np.array([-1, -1, 2])):
        want = [int(((terms[: len(terms) - k] == terms[k:]) & (terms[: len(terms) - k] >= 0)).sum()) for k in range(len(terms) // 2 + 1)]
        assert stuffing.agreement(terms).tolist()[1:] == want[1:]
    assert measure(". ".join([CYCLE] * 8))["bourrage"] > 0.9
    assert measure("\n".join([CYCLE.replace(", ", "\n")] * 8))["bourrage"] > 0.9
    refrain = "Quand la lumière décline sur le port et que les marins regagnent leurs maisons, il ne reste au large que le phare et son gardien."
    assert measure(" ".join([refrain] * 8))["bourrage"] == 0.0


def test_short_pages_of_links(spark):
    df = spark.createDataFrame([(1, "https://a.test/1 pompe\nhttps://a.test/2 filtre"), (2, "pompe pompe pompe"), (3, "https://a.test/1 https://a.test/2"), (4, "Voir la pompe.")], "doc_id long, text string")
    assert sorted(r.doc_id for r in stuffing.stuffed_pages(df).where("spam").collect()) == [1, 2, 3]


def test_repetition_decides():
    rng = random.Random(9)
    once = [measure(t)["bourrage"] for t in SPAM]
    shuffled = rng.sample(NOUNS, len(NOUNS))
    assert all(measure(t)["regularite"] > stuffing.LEAST_STUFFED for t in SPAM[:4]) and all(x > stuffing.LEAST_STUFFED for x in once)
    assert measure(", ".join(shuffled))["listes"] == 1.0 and measure(", ".join(shuffled))["regularite"] == 0.0
    rotated = " ".join(f"{w} ? Oui, {w} ! Cliquez ici pour {w} et promo." for w in [*NOUNS, *NOUNS])
    assert measure(rotated)["regularite"] > 0.9

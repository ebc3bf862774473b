"""Problem 4: free-entered values mapped to a canonical list by token-level repair and soft TF-IDF."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_margin, materialize

# Words that carry no meaning in a label, and words (with their usual short forms) that only announce one, where the list itself does not use them.
EMPTY_WORDS = frozenset("a au aux d de des du en et l la le les un une".split())
LEAD_WORDS = frozenset("cat categorie chap chapitre dom domaine intitule rub rubr rubrique sect section suite sujet theme thematique titre".split())
#: Digits typed for letters.
DIGIT_LETTERS = str.maketrans("01", "ol")
#: Edits by which a value written without its blanks may differ from an entry to be looked up by its letters alone.
GLUED_EDITS = 3
#: Squared weight of a token that matches no reference word.
STRANGE = 2.5**2
#: Least score of an accepted entry.
LEAST_SCORE = 0.62


def fold(text: str) -> str:
    """Lower case, without accents, ligatures parted."""
    text = text.replace("œ", "oe").replace("Œ", "OE").replace("æ", "ae").replace("Æ", "AE")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def tokens_of(value: str) -> list[str]:
    """Folded tokens of a typed value; an abbreviated token keeps its full stop.

    Camel case is parted, digits inside words read as the letters they look like, words that only
    announce the value ("rubrique", "suite") stay here and are left out by ``rank``'s callers, where the list does not use them.
    """
    value = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", value)
    value = fold(value)
    value = re.sub(r"[0-9a-z]+", lambda m: m.group().translate(DIGIT_LETTERS) if re.search(r"[a-z]", m.group()) else m.group(), value)
    return [m.group() for m in re.finditer(r"[a-z0-9]+\.?", value)]


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; most + 1 where it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        least = i
        for j, y in enumerate(b, 1):
            d = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], row[j - 1])
            if x != y and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
            if d < least:
                least = d
        if least > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(length: int) -> int:
    """Edits allowed in a token of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2


def deletions(token: str, depth: int) -> set[str]:
    """The token and what is left of it after up to ``depth`` deletions."""
    out = last = {token}
    for _ in range(depth):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


class Entry:
    """An entry of the canonical list, prepared for ranking."""

    __slots__ = ("ident", "words", "content", "weight", "norm", "spellings", "initials")

    def __init__(self, ident: int, words: list[str], weights: list[float]):
        self.ident, self.words = ident, words
        self.weight = dict(zip(words, weights))
        self.content = [w for w in words if w not in EMPTY_WORDS]
        self.norm = math.sqrt(sum(x * x for x in weights)) or 1.0
        self.spellings = spellings(words)
        self.initials = initials(words)


def words_of(label: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", fold(label))


def spellings(words: list[str]) -> set[str]:
    """An entry's letters without blanks: all of them, without empty words, and with the order turned round."""
    full = [w for w in words if w not in EMPTY_WORDS]
    return {"".join(words), "".join(full)} | ({"".join(reversed(full))} if len(full) > 1 else set())


def initials(words: list[str]) -> set[str]:
    full = [w for w in words if w not in EMPTY_WORDS]
    return {"".join(w[0] for w in words), "".join(w[0] for w in full)} if len(full) > 1 else set()


def word_weight(word: str, entries: int, holders: int) -> float:
    return (0.15 if word in EMPTY_WORDS else 1.0) * math.log(1 + (entries + 1) / holders)


class Reference:
    """A small canonical list as a whole."""

    def __init__(self, rows: Iterable[tuple[int, str]]):
        parted = [(int(i), words_of(str(s))) for i, s in rows if i is not None and s is not None]
        holders = Counter(w for _, ws in parted for w in set(ws))
        self.weight = {w: word_weight(w, len(parted), n) for w, n in holders.items()}
        self.entries = [Entry(i, ws, [self.weight[w] for w in ws]) for i, ws in parted]


def segments(text: str) -> list[tuple[int, str]]:
    """GLUED_EDITS + 1 pieces of the text, with their places: of any text within so many edits one piece is whole (pigeonhole)."""
    n = GLUED_EDITS + 1
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def entry_keys(words: list[str]) -> list[str]:
    """Keys under which the letters of an entry are looked up."""
    return sorted({f"{len(s)} {i} {piece}" for s in spellings(words) if len(s) > GLUED_EDITS for i, (_, piece) in enumerate(segments(s))} | {f"! {x}" for x in initials(words)})


def value_keys(glued: str, longest: int) -> list[str]:
    """Keys of all entries whose letters are within GLUED_EDITS edits, or whose initials the value is; none for a value longer than any of them."""
    out = {f"! {glued}"} if 2 <= len(glued) <= 6 else set()
    if 3 < len(glued) <= longest + GLUED_EDITS:
        n = GLUED_EDITS + 1
        for size in range(max(n, len(glued) - GLUED_EDITS), len(glued) + GLUED_EDITS + 1):
            for i in range(n):
                a, b = i * size // n, (i + 1) * size // n
                for at in range(max(0, a - GLUED_EDITS), min(len(glued) - (b - a), a + GLUED_EDITS) + 1):
                    out.add(f"{size} {i} {glued[at : at + b - a]}")
    return sorted(out)


def leading_words(tokens: list[str], repairs: dict[str, list[tuple[str, float, float]]]) -> list[str]:
    """The reference words by which candidates are looked up: those of the rarest tokens.

    The score of an entry is at most the root of the share of the tokens' squared weight that it matches. Tokens of the commonest words are left out as long
    as an entry that matched nothing else could not reach LEAST_SCORE: no entry that can be accepted for its tokens is lost.
    """
    able = []
    rest = 0.0
    for t in tokens:
        bare = t.rstrip(".")
        reads = repairs.get(bare, ())
        if bare in EMPTY_WORDS:
            continue
        if not reads:
            rest += 0.0 if len(bare) == 1 and t.endswith(".") else STRANGE  # one letter with a full stop may stand for any word
        else:
            able.append((max(w for _, _, w in reads) ** 2, min(min(w for _, _, w in reads) ** 2, STRANGE), [m for m, _, _ in reads]))
    able.sort(key=lambda x: x[0])
    least = sum(x[1] for x in able) + rest
    left_out = skipped = 0.0
    k = 0
    for most, low, _ in able:
        if skipped + most >= LEAST_SCORE**2 * (skipped + most + least - left_out - low):
            break
        skipped, left_out, k = skipped + most, left_out + low, k + 1
    return sorted({m for _, _, ms in able[k:] for m in ms})


def _abbreviates(parts: list[str], words: list[str]) -> bool:
    """Whether the parts shorten the words one by one, in order."""
    return len(parts) == len(words) and all(w.startswith(p) for p, w in zip(parts, words))


def rank(ref: Reference | list[Entry], tokens: list[str], repairs: dict[str, list[tuple[str, float]]]) -> tuple[int, float]:
    """(id, score) of the entry meant by the tokens, among those of a list or of the candidates; id 0 where none scores LEAST_SCORE.

    ``repairs`` gives, for a token, reference words with their likeness. Soft TF-IDF weighs the repaired
    tokens; spellings without blanks, initials and shortened words are further readings of the same tokens.
    On a tie the smaller id is taken.
    """
    if not tokens:
        return 0, 0.0
    bare = [t.rstrip(".") for t in tokens]
    glued = "".join(bare)
    full = [t for t in bare if t not in EMPTY_WORDS] or bare
    short = any(t.endswith(".") for t in tokens)
    best = (0.0, 0)
    for entry in ref.entries if isinstance(ref, Reference) else ref:
        ident, words, content, norm, weight = entry.ident, entry.words, entry.content, entry.norm, entry.weight
        # soft TF-IDF over repaired tokens: a word of the entry serves one token
        left, got, mass = list(words), 0.0, 0.0
        for raw, t in zip(tokens, bare):
            like = dict(repairs.get(t, ()))
            if t in EMPTY_WORDS and t not in words and not raw.endswith("."):
                mass += 0.02
                continue
            pick, sim = None, 0.0
            for w in left:
                s = 1.0 if w == t else like.get(w, 0.0)
                if s < 0.8 and w not in EMPTY_WORDS and raw.endswith(".") and w.startswith(t):
                    s = max(s, 0.9 if len(t) > 2 else 0.6)
                if s > sim:
                    pick, sim = w, s
            w_t = weight[pick] if pick else 2.5 if t not in EMPTY_WORDS else 0.3
            mass += w_t * w_t
            if pick:
                left.remove(pick)
                got += sim * w_t * weight[pick]
        score = got / (norm * math.sqrt(mass)) if mass else 0.0
        # the same letters with blanks lost, moved or doubled
        most = 1 + max(len(glued), 4) // 4
        for s in entry.spellings:
            if abs(len(s) - len(glued)) <= most and len(glued) > 3:
                bag = Counter(s)
                bag.subtract(glued)
                if max(sum(v for v in bag.values() if v > 0), -sum(v for v in bag.values() if v < 0)) <= most and (d := osa(glued, s, most)) <= most:
                    score = max(score, 1.0 - 1.25 * d / max(len(s), len(glued)))
            if short and 4 < len(glued) < len(s):
                slack = 1 + len(glued) // 8
                d = min(osa(glued, s[: len(glued) + k], slack) for k in (-1, 0, 1))
                if d <= slack:
                    score = max(score, 0.88 - 0.1 * d)
        if glued in entry.initials and 2 <= len(glued) <= 6:
            score = max(score, 0.9)
        elif len(bare) > 1 and (_abbreviates(bare, words) or _abbreviates(full, content)) and max(map(len, bare)) > 2:
            score = max(score, 0.8)
        if score > best[0] + 1e-9 or abs(score - best[0]) <= 1e-9 and best[1] and ident < best[1]:
            best = (score, ident)
    return (best[1], best[0]) if best[0] >= LEAST_SCORE else (0, best[0])


def map_values(values: DataFrame, reference: DataFrame, value: str = "valeur", entry_id: str = "rubric_id", label: str = "libelle") -> DataFrame:
    """(valeur, entree, score): the entry of ``reference`` that each distinct value of ``values`` means.

    Null and blank values are left out; entree is 0 where no entry is meant. Values equal to a
    label map to it. Distinct values are parted into tokens; each distinct token is joined to
    the reference vocabulary by edit distance (an equi-join on what is left after up to two deletions,
    then the exact distance; tokens longer than any word allows are not repaired). The repaired tokens lead to the candidates: entries that hold the words of a value's rarest
    tokens, words that begin with a shortened token, one slip allowed, entries with these initials, and, where a token stays unknown, entries whose letters without blanks lie within
    GLUED_EDITS edits (found by the piece that so many edits leave whole). Soft TF-IDF over the repaired tokens then ranks a value's candidates only. Reference lists of any size; an empty
    one maps everything to 0. Entries with a null id or label are ignored.
    """

    @F.pandas_udf("array<string>")
    def words_udf(col: pd.Series) -> pd.Series:
        return col.map(words_of)

    @F.pandas_udf("array<string>")
    def tokens_udf(col: pd.Series) -> pd.Series:
        return col.map(tokens_of)

    @F.pandas_udf("array<string>")
    def deletions_udf(col: pd.Series) -> pd.Series:
        return col.map(lambda t: sorted(deletions(t, allowed(len(t)))))

    @F.pandas_udf("double")
    def likeness_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        def like(x: str, y: str) -> float:
            most = max(allowed(len(x)), allowed(len(y)))
            d = osa(x, y, most)
            return 0.0 if d > most else 1.0 - 0.8 * d / max(len(x), len(y))

        return pd.Series([like(x, y) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("array<string>")
    def entry_keys_udf(col: pd.Series) -> pd.Series:
        return col.map(lambda ws: entry_keys(list(ws)))

    # the list: entries with their words and weights, words with their entries
    listed = reference.select(F.col(entry_id).cast("int").alias("id"), F.col(label).cast("string").alias("nom")).where("id is not null and nom is not null")
    listed = materialize(listed.withColumn("mots", words_udf("nom")).withColumn("e", F.xxhash64("id", "nom")).dropDuplicates(["e"]), "liste")
    size = listed.count()
    held = listed.select("e", F.posexplode("mots").alias("place", "mot"))
    words = held.groupBy("mot").agg(F.countDistinct("e").alias("tenants"))
    empty = F.col("mot").isin(*EMPTY_WORDS)
    words = materialize(words.withColumn("poids", F.when(empty, 0.15).otherwise(1.0) * F.log(1 + F.lit(size + 1.0) / F.col("tenants"))), "lexique")
    weights = held.join(words, "mot").groupBy("e").agg(F.sort_array(F.collect_list(F.struct("place", "mot", "poids"))).alias("mots"))
    entries = materialize(listed.select("e", "id").join(weights, "e"), "entrees_ref")
    holders = held.select("mot", "e").distinct()
    longest, longest_entry = words.agg(F.coalesce(F.max(F.length("mot")), F.lit(0))).first()[0], listed.agg(F.coalesce(F.max(F.length(F.array_join("mots", ""))), F.lit(0))).first()[0]

    # the values, their tokens, and the tokens' readings
    distinct = values.select(F.col(value).cast("string").alias("valeur")).where(F.trim(F.regexp_replace("valeur", r"\s", " ")) != "").distinct()
    own = {r[0] for r in words.where(F.col("mot").isin(*LEAD_WORDS)).select("mot").collect()}
    lead = [F.lit(w) for w in sorted(LEAD_WORDS - own)]
    bare = lambda t: F.rtrim(F.regexp_replace(t, r"\.", " "))
    distinct = distinct.withColumn("jetons", tokens_udf("valeur")).withColumn("jetons", F.filter("jetons", lambda t: ~bare(t).isin(*lead)))
    distinct = materialize(distinct, "valeurs")
    used = distinct.select("valeur", F.explode(F.array_distinct(F.transform("jetons", bare))).alias("jeton"))
    tokens = materialize(used.groupBy("jeton").agg(F.count("*").alias("fois")), "jetons_saisis")
    by_rest = tokens.where(F.length("jeton") <= longest + 2).select("jeton", F.explode(deletions_udf("jeton")).alias("reste"))
    pairs = by_rest.join(words.select("mot", F.explode(deletions_udf("mot")).alias("reste")), "reste").select("jeton", "mot").distinct()
    near = pairs.withColumn("s", likeness_udf("jeton", "mot")).where("s > 0").join(words, "mot").select("jeton", "mot", "s", "poids")
    repairs = near.groupBy("jeton").agg(F.collect_list(F.struct("mot", "s", "poids")).alias("lectures")).join(tokens, "jeton")
    repairs = materialize(repairs, "lectures")
    total = tokens.agg(F.coalesce(F.sum("fois"), F.lit(1))).first()[0]
    reads = join_margin(used, repairs, "jeton", F.col("fois"), total).groupBy("valeur").agg(F.collect_list(F.struct("jeton", "lectures")).alias("lectures"))
    joined = materialize(distinct.join(reads, "valeur", "left"), "repares")

    def repaired(reads) -> dict[str, list[tuple[str, float, float]]]:
        return {x["jeton"]: [(y["mot"], y["s"], y["poids"]) for y in x["lectures"]] for x in reads} if reads is not None else {}

    @F.pandas_udf("array<string>")
    def leading_udf(jetons: pd.Series, lectures: pd.Series) -> pd.Series:
        return pd.Series([leading_words(list(ts), repaired(rs)) for ts, rs in zip(jetons, lectures)])

    @F.pandas_udf("array<string>")
    def keys_udf(jetons: pd.Series, lectures: pd.Series) -> pd.Series:
        def one(ts: list[str], known: dict) -> list[str]:
            plain = [t.rstrip(".") for t in ts]
            return value_keys("".join(plain), longest_entry) if any(t not in known and t not in EMPTY_WORDS for t in plain) or len(plain) == 1 else []

        return pd.Series([one(list(ts), repaired(rs)) for ts, rs in zip(jetons, lectures)])

    # candidates: by words, by beginnings of words, by letters and initials
    by_word = joined.select("valeur", F.explode(leading_udf("jetons", "lectures")).alias("mot"))
    beginnings = words.where(~empty).select("mot", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("mot"))), lambda n: F.substring("mot", 1, n))).alias("jeton")).where(F.col("jeton") != F.col("mot"))
    shortened = joined.select("valeur", F.explode("jetons").alias("t")).select("valeur", bare(F.col("t")).alias("jeton"), F.col("t").endswith(".").alias("abrege"))
    shortened = shortened.join(repairs.select("jeton", F.lit(True).alias("connu")), "jeton", "left").where("abrege or connu is null").where(F.length("jeton").between(2, longest)).select("valeur", "jeton").distinct()

    @F.pandas_udf("array<string>")
    def slips_udf(col: pd.Series) -> pd.Series:
        return col.map(lambda t: sorted(deletions(t, len(t) > 3)))

    shortened, beginnings = [d.select("*", F.explode(slips_udf("jeton")).alias("reste")) for d in (shortened, beginnings)]
    opens = shortened.join(beginnings, "reste").select("valeur", "mot").distinct()
    asked = by_word.unionByName(opens).distinct()
    lists = holders.groupBy("mot").agg(F.collect_list("e").alias("es")).join(asked.groupBy("mot").agg(F.count("*").alias("fois")), "mot")
    by_word = join_margin(asked, lists, "mot", F.col("fois"), total).select("valeur", F.explode("es").alias("e"))
    by_letters = joined.select("valeur", F.explode(keys_udf("jetons", "lectures")).alias("cle_e")).join(listed.select("e", F.explode(entry_keys_udf("mots")).alias("cle_e")), "cle_e").select("valeur", "e")
    candidates = by_word.unionByName(by_letters).distinct().join(entries, "e").groupBy("valeur").agg(F.collect_list(F.struct("id", "mots")).alias("candidats"))

    @F.pandas_udf("entree int, score double")
    def rank_udf(jetons: pd.Series, lectures: pd.Series, candidats: pd.Series) -> pd.DataFrame:
        out, made = [], {}
        for toks, rs, cs in zip(jetons, lectures, candidats):
            found = []
            for c in cs if cs is not None else ():
                key = (c["id"], *(w["mot"] for w in c["mots"]))
                if key not in made:
                    made[key] = Entry(c["id"], [w["mot"] for w in c["mots"]], [w["poids"] for w in c["mots"]])
                found.append(made[key])
            out.append(rank(found, list(toks), {t: [(m, s) for m, s, _ in x] for t, x in repaired(rs).items()}))
        return pd.DataFrame(out, columns=["entree", "score"])

    wide = joined.join(candidates, "valeur", "left").repartition(3 * values.sparkSession.sparkContext.defaultParallelism)  # ranking costs far more than its bytes tell
    ranked = wide.select("valeur", rank_udf.asNondeterministic()("jetons", "lectures", "candidats").alias("r")).select("valeur", "r.entree", F.round("r.score", 6).alias("score"))
    exact = listed.groupBy(F.col("nom").alias("valeur")).agg(F.min("id").alias("exact"))
    return ranked.join(exact, "valeur", "left").select("valeur", F.coalesce("exact", "entree").alias("entree"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))


def free_values(articles: DataFrame, requests: DataFrame) -> DataFrame:
    """(champ, cle, pos, valeur) of every rubric typed in articles and requests."""
    a = articles.select(F.lit("rubrique").alias("champ"), F.col("fichier").alias("cle"), F.lit(0).alias("pos"), F.col("rubrique").alias("valeur"))
    r = requests.select(F.lit("rubric_terms").alias("champ"), F.col("query_id").cast("string").alias("cle"), F.posexplode("rubric_terms").alias("pos", "valeur"))
    return a.unionByName(r).where(F.trim(F.regexp_replace("valeur", r"\s", " ")) != "").distinct()


def map_rubrics(articles: DataFrame, requests: DataFrame, reference: DataFrame) -> DataFrame:
    """(champ, cle, pos, valeur, rubric_id, score) of every non-blank typed rubric, exact ones included.

    Null and blank values, null and empty lists give no rows; repeated rows count once.
    """
    values = materialize(free_values(articles, requests), "saisies")
    counts = values.groupBy("valeur").agg(F.count("*").alias("lignes"))
    mapped = materialize(map_values(values, reference).join(counts, "valeur"), "entrees")
    return join_margin(values, mapped, "valeur", F.col("lignes"), values.count() or 1).select("champ", "cle", "pos", "valeur", F.col("entree").alias("rubric_id"), "score")

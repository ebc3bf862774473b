"""Problem 1: garbled text from wrong character encoding, by expectation-maximisation over latent encoding chains."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_margin, materialize, spread

# Encoding chains, each a list of (encoding the bytes were read in, encoding they were written in), undone from left to right.
CHAINS: list[tuple[str, list[tuple[str, str]]]] = [
    ("utf8<cp1252", [("cp1252", "utf-8")]),
    ("utf8<latin1", [("latin-1", "utf-8")]),
    ("utf8<latin9", [("iso8859-15", "utf-8")]),
    ("utf8<mac", [("mac_roman", "utf-8")]),
    ("utf8<cp437", [("cp437", "utf-8")]),
    ("utf8<cp850", [("cp850", "utf-8")]),
    ("utf8<cp1250", [("cp1250", "utf-8")]),
    ("utf8<latin2", [("iso8859-2", "utf-8")]),
    ("utf8<cp1251", [("cp1251", "utf-8")]),
    ("utf8<cp1252<utf8<cp1252", [("cp1252", "utf-8"), ("cp1252", "utf-8")]),
    ("utf8<latin1<utf8<latin1", [("latin-1", "utf-8"), ("latin-1", "utf-8")]),
    ("utf8<cp1252<utf8<latin1", [("latin-1", "utf-8"), ("cp1252", "utf-8")]),
    ("cp1252<mac", [("mac_roman", "cp1252")]),
    ("cp1252<cp850", [("cp850", "cp1252")]),
    ("cp1252<cp437", [("cp437", "cp1252")]),
    ("cp1252<cp1250", [("cp1250", "cp1252")]),
    ("cp1252<cp1251", [("cp1251", "cp1252")]),
    ("mac<cp1252", [("cp1252", "mac_roman")]),
    ("mac<latin1", [("latin-1", "mac_roman")]),
    ("cp850<cp1252", [("cp1252", "cp850")]),
    ("cp850<latin1", [("latin-1", "cp850")]),
    ("cp850<mac", [("mac_roman", "cp850")]),
    ("cp437<cp1252", [("cp1252", "cp437")]),
]
NAMES = [n for n, _ in CHAINS]
LOST = "perdu"
#: Characters that ordinary French text holds without being suspect.
ORDINARY = "\\x00-\\x7féèêëàâîïôöûùüçœæ«»’"
SUSPECT = f"[^{ORDINARY}]"

# Private characters that stand for bytes 0x80 to 0xFF while a text is taken back to bytes.
_PUA = 0xE000
_seq = re.compile("[-][-]|[-][-]{2}|[-][-]{3}")


@lru_cache(maxsize=None)
def _to_bytes(codec: str) -> dict[int, int]:
    """Character to private byte character; bytes a codec leaves undefined are read as the control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = _PUA + b
    if codec == "cp1252":  # a reader that leaves control bytes as they are
        for b in range(0x80, 0xA0):
            out.setdefault(b, _PUA + b)
    return out


@lru_cache(maxsize=None)
def _from_bytes(codec: str) -> dict[int, str]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[_PUA + b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[_PUA + b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _back(codec: str) -> dict[int, int]:
    return {v: k for k, v in reversed(_to_bytes(codec).items())}


def undo(token: str, steps: list[tuple[str, str]]) -> str:
    """The token with one chain undone, as far as its characters allow; sequences that do not decode stay."""
    for wrong, right in steps:
        raw = token.translate(_to_bytes(wrong))
        if right != "utf-8":
            token = raw.translate(_from_bytes(right))
            continue
        raw = _seq.sub(lambda m: bytes(ord(c) - _PUA for c in m.group()).decode("utf-8", "replace"), raw)
        token = raw.translate(_back(wrong))
        if token == "Ã" and wrong in ("cp1252", "latin-1", "iso8859-15"):  # the no-break space after it became a blank
            token = "à"
    return token


def candidates(token: str) -> dict[str, list[int]]:
    """Readings of a token that differ from it, with the chains that give them."""
    out: dict[str, list[int]] = {}
    for i, (_, steps) in enumerate(CHAINS):
        got = undo(token, steps)
        if got != token and not any("" <= c <= "" for c in got):
            out.setdefault(got, []).append(i)
    return out


def fold(c: str) -> str:
    """The symbol a character counts as: itself in the scripts at hand, else its block; so the alphabet is bounded."""
    o = ord(c)
    if c.isdigit():
        return "0"
    if o < 0x180 or 0x370 <= o < 0x460 or 0x2010 <= o < 0x2048 or 0x20A0 <= o < 0x20C0 or 0x2100 <= o < 0x2140 or 0x2200 <= o < 0x2280 or 0x2500 <= o < 0x25A0 or 0x2C0 <= o < 0x2E0:
        return c
    return chr(0xF0000 + (o >> 8))


class Language:
    """Bigrams of characters in the tokens of the collection, smoothed."""

    def __init__(self, pairs: dict[tuple[str, str], float]):
        self.first: Counter = Counter()
        self.single: Counter = Counter()
        for (a, b), n in pairs.items():
            self.first[a] += n
            self.single[b] += n
        self.total = sum(self.single.values()) or 1.0
        self.pairs = pairs
        self.memo: dict[tuple[str, str], float] = {}

    def log(self, a: str, b: str) -> float:
        got = self.memo.get((a, b))
        if got is None:
            base = (self.single[b] + 0.05) / (self.total + 100)
            got = self.memo[a, b] = math.log((self.pairs.get((a, b), 0.0) + 4 * base) / (self.first[a] + 4))
        return got

    def score(self, token: str) -> float:
        folded = [" ", *map(fold, token), " "]
        return sum(self.log(a, b) for a, b in zip(folded, folded[1:]))


def pairs_of(tokens, weights) -> Counter:
    out: Counter = Counter()
    for t, n in zip(tokens, weights):
        folded = [" ", *map(fold, t), " "]
        for p in zip(folded, folded[1:]):
            out[p] += n
    return out


_letters = re.compile("[A-Za-z]")
_TWO_LETTERS = "(?s)[A-Za-z].*[A-Za-z]"
#: Chains of single-byte encodings only.
_SINGLE = frozenset(i for i, (_, steps) in enumerate(CHAINS) if all(right != "utf-8" for _, right in steps))


def gains(token: str, language: Language) -> list[tuple[int, str, float]]:
    """(chain, reading, log likelihood against the token as written) of all readings, unlikely ones too: their records and sources may speak for them.

    A sign without letters around it is no evidence for a chain of single bytes: such readings
    lose a little, so that only their record and source can make them likely.
    """
    own = language.score(token)
    bare = len(_letters.findall(token)) < 2
    out = []
    for got, chains in candidates(token).items():
        gain = language.score(got) - own
        out += [(i, got, min(gain, -1.0) if bare and i in _SINGLE else gain) for i in chains]
    return out


def _count_pairs(tokens: DataFrame, column: str) -> Language:
    """The language model of a table (column, n). Its alphabet is bounded by ``fold``, so is what comes to the driver."""

    def count(batches):
        total: Counter = Counter()
        for pdf in batches:
            total.update(pairs_of(pdf[column], pdf["n"]))
        yield pd.DataFrame([(a, b, float(n)) for (a, b), n in total.items()], columns=["a", "b", "n"])

    rows = tokens.select(column, "n").mapInPandas(count, "a string, b string, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return Language({(r["a"], r["b"]): r["n"] for r in rows.toLocalIterator()})


def _weigh(tokens: DataFrame, language: Language) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, dict(language.pairs)))

    @F.pandas_udf("array<struct<chaine:int,lecture:string,gain:double>>")
    def weigh(col: pd.Series) -> pd.Series:
        model = _model(shared)
        return col.map(lambda t: [{"chaine": i, "lecture": s, "gain": g} for i, s, g in gains(t, model)])

    return tokens.withColumn("lectures", weigh("jeton"))


_models: dict[str, Language] = {}


def _model(shared) -> Language:
    """The worker's model of a broadcast; built once."""
    name, pairs = shared.value
    if name not in _models:
        _models.clear()
        _models[name] = Language(pairs)
    return _models[name]


#: Weight of the collection's prior in a source's, and of a source's in a record's, in tokens; share of garbled tokens assumed at first.
PRIOR_TOKENS, RECORD_TOKENS, FIRST_SHARE = 50.0, 4.0, 0.05
ROUNDS = 3
#: Posterior of all chains above which a token counts as garbled; most garbled tokens lie far above, most others far below.
LEAST_POSTERIOR = 0.3
#: The same in a record that surely has other garbled tokens.
SURE_POSTERIOR = 0.15


def _posterior(prior: Column) -> Column:
    """Per reading its posterior, given an array of priors per chain; ``lectures`` holds the readings."""
    weight = lambda x: F.element_at(prior, x["chaine"] + 1) * F.exp(F.least(x["gain"], F.lit(60.0)))
    rest = 1 - F.aggregate(prior, F.lit(0.0), lambda a, x: a + x)
    total = F.greatest(rest, F.lit(1e-9)) + F.aggregate(F.col("lectures"), F.lit(0.0), lambda a, x: a + weight(x))
    return F.transform("lectures", lambda x: F.struct(x["chaine"].alias("chaine"), x["lecture"].alias("lecture"), (weight(x) / total).alias("p")))


def _prior_of(rows: DataFrame, keys: list[str], base: Column, tokens: float) -> DataFrame:
    """Prior per chain for each key: posterior sums over ``tous``, all its non-ASCII tokens, smoothed by ``base``.

    ``base`` is a constant array, ``tous`` constant within a key. Tokens without letters have no voice.
    """
    voice = F.col("n") * F.col("jeton").rlike(_TWO_LETTERS).cast("long")
    each = rows.select(*keys, "tous", voice.alias("v"), F.explode("post").alias("x")).groupBy(*keys, F.col("x.chaine").alias("chaine")).agg(F.sum(F.col("v") * F.col("x.p")).alias("s"), F.max("tous").alias("tous"))
    out = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("chaine", "s"))).alias("par_chaine"), F.max("tous").alias("tous"))
    shares = F.array(*[F.coalesce(F.try_element_at("par_chaine", F.lit(i)), F.lit(0.0)) for i in range(len(CHAINS))])
    return out.select(*keys, F.zip_with(shares, base, lambda s, b: (s + b * tokens) / (F.col("tous") + tokens)).alias("prior"))


#: E- and M-steps within a record.
RECORD_ROUNDS = 12


def settle_record(tokens, prior, total: float) -> list[dict]:
    """The tokens of one record with their likeliest readings: EM over the record's own prior, smoothed by its source's.

    ``tokens`` are few: the suspect ones of one text. ``total`` is the number of its non-ASCII tokens.
    """
    base = [float(x) for x in prior]
    share = list(base)
    options = [(t["jeton"], t["n"], len(_letters.findall(t["jeton"])) > 1, [(x["chaine"], math.exp(min(x["gain"], 60.0)), x["lecture"]) for x in t["lectures"]]) for t in tokens]
    for step in range(RECORD_ROUNDS):
        rest = max(1e-9, 1.0 - sum(share))
        sums = [0.0] * len(base)
        out = []
        for token, n, voice, reads in options:
            weights = [share[c] * w for c, w, _ in reads]
            all_ = rest + sum(weights)
            if voice:
                for (c, _, _), w in zip(reads, weights):
                    sums[c] += n * w / all_
            if step == RECORD_ROUNDS - 1:
                best = max(range(len(reads)), key=lambda i: (weights[i], -reads[i][0]))
                out.append({"jeton": token, "lecture": reads[best][2], "chaine": NAMES[reads[best][0]], "p": 1.0 - rest / all_})
        share = [(s + b * RECORD_TOKENS) / (total + RECORD_TOKENS) for s, b in zip(sums, base)]
    sure = max((t["p"] for t in out), default=0.0) > 0.9
    return [t for t in out if t["p"] > (SURE_POSTERIOR if sure else LEAST_POSTERIOR)]


def damaged_tokens(rows: DataFrame, fields: list[str], key: str, source: str) -> DataFrame:
    """(cle, champ, jeton, lecture, chaine, p) of every token of the named fields that a wrong encoding garbled.

    EM: a token's latent state is 'as written' or one encoding chain, with a prior per source and field; its likelihood is that of the
    reading under a character model of the collection. E-steps weigh each distinct token of a source, M-steps
    pool the weights per source and field, smoothed by the collection's; the character model is fitted
    again on the tokens as read after a first pass. At last each record's own tokens update its source's
    prior by EM, and a token is garbled where the posterior of all chains exceeds LEAST_POSTERIOR (SURE_POSTERIOR in a record
    with others beyond doubt); its reading is the likeliest.
    Tokens with U+FFFD are garbled for good: chaine 'perdu', lecture null. Repeated rows and null fields: null texts hold no tokens, rows equal in key and field are pooled, a text delivered twice speaks twice. A null source is a source of its own.
    """
    spark = rows.sparkSession
    parts = [rows.select(F.col(key).cast("string").alias("cle"), F.lit(f).alias("champ"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("site"), F.col(f).alias("texte")) for f in fields]
    texts = parts[0]
    for p in parts[1:]:
        texts = texts.unionByName(p)
    tokens = texts.where(F.col("texte").isNotNull()).select("cle", "champ", "site", F.explode(F.split("texte", r"[ \n\t\r]+")).alias("jeton")).where(F.col("jeton").rlike(r"[^\x00-\x7f]"))
    counted = materialize(tokens.groupBy("cle", "champ", "site", "jeton").agg(F.count("*").alias("n")), "jetons")
    vocabulary = materialize(counted.groupBy("jeton").agg(F.sum("n").alias("n")), "vocabulaire")
    suspects = vocabulary.where(F.col("jeton").rlike(SUSPECT) & ~F.col("jeton").contains("�"))
    suspects = spread(suspects)
    first = _weigh(suspects, _count_pairs(vocabulary, "jeton"))
    flat = F.array(*[F.lit(FIRST_SHARE / len(CHAINS))] * len(CHAINS))
    likeliest = F.reduce("post", F.struct(F.lit(-1).alias("chaine"), F.lit(None).cast("string").alias("lecture"), F.lit(-1.0).alias("p")), lambda a, x: F.when(x["p"] > a["p"], x).otherwise(a))
    garbled = F.aggregate("post", F.lit(0.0), lambda a, x: a + x["p"]) > 0.5
    lu = first.withColumn("post", _posterior(flat)).select("jeton", F.when(garbled, likeliest["lecture"]).alias("lu"))
    read = vocabulary.join(lu, "jeton", "left").select(F.coalesce("lu", "jeton").alias("lu"), "n")
    weighed = materialize(_weigh(suspects, _count_pairs(read, "lu")), "lectures")
    able = weighed.where(F.size("lectures") > 0).select("jeton", "lectures", F.col("n").alias("partout"))
    seen = able.agg(F.coalesce(F.sum("partout"), F.lit(1))).first()[0]
    mine = materialize(join_margin(counted.where(F.col("jeton").rlike(SUSPECT)), able, "jeton", F.col("partout"), seen).drop("partout"), "suspects")
    name = F.to_json(F.struct("site", "champ")).alias("source")
    pooled = counted.where(F.col("jeton").rlike(SUSPECT)).groupBy("site", "champ", "jeton").agg(F.sum("n").alias("n"))
    by_source = materialize(join_margin(pooled, able, "jeton", F.col("partout"), seen).select(name, "jeton", "n", "lectures"), "sources")
    size = by_source.count()
    totals = materialize(counted.groupBy("site", "champ").agg(F.sum("n").alias("tous")).select(name, "tous"), "totaux")
    everything = totals.agg(F.coalesce(F.sum("tous"), F.lit(0))).first()[0]
    # the collection's prior, then each source's
    prior = [FIRST_SHARE / len(CHAINS)] * len(CHAINS)
    overall = able.withColumnRenamed("partout", "n")
    for _ in range(ROUNDS):
        got = _prior_of(overall.withColumn("post", _posterior(F.array(*map(F.lit, prior)))).withColumn("k", F.lit(1)).withColumn("tous", F.lit(everything)), ["k"], flat, PRIOR_TOKENS).first()
        prior = list(got["prior"]) if got else prior
    base = F.array(*map(F.lit, prior))
    sources = materialize(by_source.groupBy("source").agg(F.count("*").alias("lignes")).join(totals, "source").withColumn("prior", base), "priors")
    for _ in range(ROUNDS):
        joined = join_margin(by_source, sources, "source", F.col("lignes"), size or 1)
        again = _prior_of(joined.withColumn("post", _posterior(F.col("prior"))), ["source"], base, PRIOR_TOKENS)
        sources = materialize(again.join(sources.select("source", "lignes", "tous"), "source").select("source", "lignes", "tous", "prior"), "priors")
    records = counted.groupBy("cle", "champ").agg(F.sum("n").alias("tous"))
    joined = join_margin(mine.select("cle", "champ", name, "jeton", "n", "lectures"), sources.drop("tous"), "source", F.col("lignes"), size or 1)
    likeliest_gain = F.aggregate("lectures", F.lit(-1e9), lambda a, x: F.greatest(a, x["gain"]))
    each = joined.groupBy("cle", "champ").agg(F.collect_list(F.struct("jeton", "n", "lectures")).alias("jetons"), F.first("prior").alias("prior"), F.max(likeliest_gain).alias("gain"))
    # where no reading is likelier than what is written, the posteriors of a token add up to no more than its source's priors at any step
    each = each.where((F.col("gain") > 0) | (F.aggregate("prior", F.lit(0.0), lambda a, x: a + x) >= LEAST_POSTERIOR))
    each = each.join(records, ["cle", "champ"])

    @F.pandas_udf("array<struct<jeton:string,lecture:string,chaine:string,p:double>>")
    def settle(jetons: pd.Series, prior: pd.Series, tous: pd.Series) -> pd.Series:
        return pd.Series([settle_record(j, q, t) for j, q, t in zip(jetons, prior, tous)])

    garbled = each.select("cle", "champ", F.explode(settle("jetons", "prior", "tous")).alias("t")).select("cle", "champ", "t.*")
    garbled = garbled.withColumn("p", F.round("p", 6))
    lost = counted.where(F.col("jeton").contains("�")).select("cle", "champ", "jeton", F.lit(None).cast("string").alias("lecture"), F.lit(LOST).alias("chaine"), F.lit(1.0).alias("p"))
    return garbled.unionByName(lost)


def repaired_texts(rows: DataFrame, fields: list[str], key: str, source: str) -> DataFrame:
    """(cle, champ, texte, texte_repare, chaines): each garbled text with its tokens read again.

    Lost tokens stay as they are. Texts without garbled tokens, and null texts, give no row.
    """
    bad = materialize(damaged_tokens(rows, fields, key, source), "abimes")
    maps = bad.groupBy("cle", "champ").agg(F.collect_set(F.struct("jeton", "lecture")).alias("jetons"), F.sort_array(F.collect_set("chaine")).alias("chaines"))
    parts = [rows.select(F.col(key).cast("string").alias("cle"), F.lit(f).alias("champ"), F.col(f).alias("texte")) for f in fields]
    texts = parts[0]
    for p in parts[1:]:
        texts = texts.unionByName(p)

    @F.pandas_udf("string")
    def mend(texte: pd.Series, jetons: pd.Series) -> pd.Series:
        out = []
        for t, js in zip(texte, jetons):
            known = {j["jeton"]: j["lecture"] for j in js if j["lecture"] is not None}
            out.append("".join(known.get(x, x) for x in re.split(r"([ \n\t\r]+)", t)))
        return pd.Series(out)

    out = texts.where(F.col("texte").isNotNull()).join(maps, ["cle", "champ"]).dropDuplicates(["cle", "champ", "texte"])
    return out.select("cle", "champ", "texte", mend("texte", "jetons").alias("texte_repare"), F.array_join("chaines", " ").alias("chaines"))

"""Problem 9: mixing sources to target weights, by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .tokens import token_count

#: Bits of the hash, and bits settled by each histogram.
BITS, STEP = 60, 12
#: Most rows of the table of mixes, which bounds what the driver holds: STEP-bit histograms of the sources it names.
MOST_PARTS = 2_000


def place(key: Column, seed: int) -> Column:
    """A number from 0 to 2**BITS - 1, evenly spread and fixed for a key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 64 - BITS)


def thresholds(docs: DataFrame, budgets: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
    """For each (mix, source) the t such that the rows of the source placed below t hold the budget of tokens, as near as whole rows come.

    ``docs`` has (source, place, n). The first histogram sums the tokens by source and the leading STEP
    bits; where the running sum passes a budget lies its boundary bucket, and only boundary buckets
    are summed again by the next bits. Budgets of one source are nested: a larger one takes all that a smaller one takes.
    """
    spark = docs.sparkSession
    prefix = {k: 0 for k in budgets}
    left = dict(budgets)
    open_ = set(budgets)
    for level in range(1, BITS // STEP + 1):
        if not open_:
            break
        wanted = spark.createDataFrame(sorted({(s, prefix[m, s]) for m, s in open_}), "source string, debut long")
        shift = BITS - level * STEP
        rows = docs.withColumn("debut", F.shiftrightunsigned("place", shift + STEP)).join(F.broadcast(wanted), ["source", "debut"])
        sums: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("source", "debut", F.shiftrightunsigned("place", shift).alias("tas")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).toLocalIterator():
            sums.setdefault((r["source"], r["debut"]), []).append((r["tas"], r["n"], r["c"]))
        for key in sorted(open_):
            for tas, n, c in sorted(sums.get((key[1], prefix[key]), [])):
                if n > left[key]:
                    prefix[key] = tas
                    if c == 1 or level == BITS // STEP:  # one row, or rows that share a place: in only where that comes nearer
                        prefix[key] = (tas + (n - left[key] < left[key])) << shift
                        open_.discard(key)
                    break
                left[key] -= n
            else:  # the whole bucket fits, by rounding only
                prefix[key] = (prefix[key] + 1) << (shift + STEP)
                open_.discard(key)
    return prefix


def mix(docs: DataFrame, mixes: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The drawn rows and the report of every mix.

    Drawn rows: (melange_id, key, source, jetons, repetitions), only those taken at least once.
    Report: (melange_id, source, part_cible, part_possible, part_reelle, jetons_source, jetons, repetitions, repetitions_max);
    part_possible is the target share among the sources that have tokens.

    Weights are divided by their sum over the sources that have tokens; a source that has none, or a null or negative weight,
    gets nothing and is reported with a real share of 0. A mix is made as large as its scarcest source allows: the total is the
    least of cap * size / share; a null cap is no limit, and where no source is capped each counts as capped at 1 for the total; a cap below 1 gives nothing. Each source is taken whole so many times
    and then once more below a hash threshold, so no row exceeds the cap, and the sum is off its target by at most half of one row's tokens.
    Null sources belong to no mix; null and empty texts have 0 tokens. Repeated (mix, source) rows: the first by weight counts.
    """
    parts = mixes.select(F.col("melange_id").cast("int").alias("m"), F.col("source").alias("s"), F.col("poids_cible").cast("double").alias("w"), F.col("repetitions_max").cast("int").alias("cap")).where("m is not null and s is not null").limit(MOST_PARTS + 1).collect()
    if len(parts) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts of mixes")
    spark = docs.sparkSession
    names = sorted({p["s"] for p in parts})
    named = F.broadcast(spark.createDataFrame([(s,) for s in names], "source string"))
    rows = spread(docs.select(key, source, text)).select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t")).join(named, "source")
    rows = materialize(rows.select("k", "source", place(F.col("k"), seed).alias("place"), token_count(F.col("t")).alias("n")), "melange")
    size = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    by_mix: dict[int, dict[str, tuple[float, int | None]]] = {}
    for p in sorted(parts, key=lambda p: (p["m"], p["s"], -(p["w"] or 0))):
        by_mix.setdefault(p["m"], {}).setdefault(p["s"], (max(p["w"] or 0.0, 0.0), p["cap"]))
    whole: dict[tuple[int, str], int] = {}
    rest: dict[tuple[int, str], int] = {}
    share: dict[tuple[int, str], float] = {}
    aim: dict[tuple[int, str], float] = {}
    for m, sources in by_mix.items():
        able = {s: w for s, (w, cap) in sources.items() if w > 0 and size.get(s) and (cap is None or cap >= 1)}
        sum_w = sum(able.values())
        sum_all = sum(w for w, _ in sources.values())
        aim |= {(m, s): w / sum_all if sum_all else 0.0 for s, (w, _) in sources.items()}
        limits = [sources[s][1] * size[s] * sum_w / w for s, w in able.items() if sources[s][1] is not None] or [size[s] * sum_w / w for s, w in able.items()]
        total = min(limits, default=0.0)
        for s, w in able.items():
            share[m, s] = w / sum_w
            budget = round(total * w / sum_w)
            whole[m, s], rest[m, s] = divmod(budget, size[s])
            cap = sources[s][1]
            if cap is not None and whole[m, s] >= cap:
                whole[m, s], rest[m, s] = cap, 0
    limit = thresholds(rows, {k: v for k, v in rest.items() if v})
    plan = spark.createDataFrame([(m, s, whole[m, s], limit.get((m, s), 0)) for m, s in sorted(whole)], "melange_id int, source string, entier int, seuil long")
    drawn = rows.join(F.broadcast(plan), "source")
    drawn = drawn.withColumn("repetitions", F.col("entier") + (F.col("place") < F.col("seuil")).cast("int")).where("repetitions > 0")
    drawn = drawn.select("melange_id", F.col("k").alias(key), "source", F.col("n").alias("jetons"), "repetitions")
    got = drawn.groupBy("melange_id", "source").agg(F.sum(F.col("jetons") * F.col("repetitions")).alias("jetons"), F.max("repetitions").alias("repetitions"))
    asked = spark.createDataFrame([(m, s, aim[m, s], share.get((m, s), 0.0), size.get(s) or 0, cap) for m, x in sorted(by_mix.items()) for s, (_, cap) in sorted(x.items())], "melange_id int, source string, part_cible double, part_possible double, jetons_source long, repetitions_max int")
    report = asked.join(F.broadcast(got), ["melange_id", "source"], "left")
    taken = F.coalesce("jetons", F.lit(0))
    report = report.withColumn("somme", F.sum(taken).over(_by_mix()))
    real = F.round(F.when(F.col("somme") > 0, taken / F.col("somme")).otherwise(0.0), 6)
    report = report.select("melange_id", "source", F.round("part_cible", 6).alias("part_cible"), F.round("part_possible", 6).alias("part_possible"), real.alias("part_reelle"), "jetons_source", taken.alias("jetons"), F.coalesce("repetitions", F.lit(0)).alias("repetitions"), "repetitions_max")
    return drawn, report


def _by_mix():
    from pyspark.sql import Window

    return Window.partitionBy("melange_id")

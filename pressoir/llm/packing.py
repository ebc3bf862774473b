"""Problem 8: filling fixed-capacity containers, by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from .tokens import token_count

#: Largest capacity: the histogram of one capacity has at most as many lengths, which bounds what the driver holds.
MOST_CAPACITY = 1_000_000
MOST_CONTAINERS = 1_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Packing patterns for so many items of each length; lengths from 0 to ``capacity``.

    Lengths are placed longest first, each into the packs filled least so far; a new pack
    is opened only where no pack has room. Packs of one pattern are kept as one range of container numbers with a
    count, so the work depends on the number of lengths, not of items. Returns the events
    (length, first rank, end rank, first container): item number r of the length goes to container first + r - first rank. Also
    returns the number of containers. Items of length 0 all go to container 0.
    """
    events: list[tuple[int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # (-space, first container, count)
    opened = 0
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank, done = histogram[length], 0, []
        while left:
            if packs and -packs[0][0] >= length:
                space, first, count = heapq.heappop(packs)
                used = min(left, count)
                if used < count:
                    heapq.heappush(packs, (space, first + used, count - used))
                space = -space - length
            else:
                # open packs, each filled with as many items of this length as it takes only where others have no room
                first, used = opened, left
                space = capacity - length
                if 2 * length <= capacity:
                    per = capacity // length
                    used = -(-left // per)
                opened += used
            events.append((length, rank, rank + used, first))
            rank += used
            left -= used
            if space:
                if space >= length and left:
                    heapq.heappush(packs, (-space, first, used))
                else:
                    done.append((-space, first, used))
        for x in done:
            heapq.heappush(packs, x)
    if histogram.get(0):
        events.append((0, 0, histogram[0], 0))
        opened = max(opened, 1)
    return events, opened


def pack(docs: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(contenant_id, conteneur, key, morceau, jetons): every text in a container, for each capacity.

    A text longer than the capacity is cut into full pieces and a rest (``morceau`` 0, 1, ...);
    no other is split. Each full piece has a container to itself. Null and empty texts have length 0 and go to container 0. Repeated keys are separate items. Capacities that are null or
    below 1 are ignored; an empty table gives an empty result.

    Only the length histograms (at most capacity + 1 numbers) and the packing events come to the driver. Items are numbered within their
    length by hash buckets, so that one length may hold any share of the rows.
    """
    sizes = containers.select("contenant_id", F.col("capacite_tokens").cast("int").alias("capacite")).where("contenant_id is not null and capacite >= 1").distinct().limit(MOST_CONTAINERS + 1).collect()
    if len(sizes) > MOST_CONTAINERS or any(r["capacite"] > MOST_CAPACITY for r in sizes):
        raise ValueError(f"more than {MOST_CONTAINERS} containers or a capacity above {MOST_CAPACITY}")
    spark = docs.sparkSession
    lengths = materialize(spread(docs.select(key, text)).select(F.col(key).alias("k"), (token_count(F.col(text), folder) if folder else token_count(F.col(text))).alias("n")), "tailles")
    total = lengths.count()
    buckets = max(16, total // 50_000)
    kinds = spark.createDataFrame([(int(r["contenant_id"]), int(r["capacite"])) for r in sizes], "contenant_id int, capacite int")
    items = lengths.join(F.broadcast(kinds)).withColumn("pieces", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / F.col("capacite"))))
    items = items.select("contenant_id", "capacite", "k", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("morceau"))
    items = items.withColumn("jetons", F.least(F.col("n") - F.col("morceau") * F.col("capacite"), F.col("capacite").cast("long")).cast("int"))
    items = items.withColumn("tas", F.pmod(F.xxhash64("k", "morceau"), F.lit(buckets)).cast("int"))
    counted = materialize(items.groupBy("contenant_id", "jetons", "tas").agg(F.count("*").alias("m")), "histogramme")
    histogram: dict[int, dict[int, int]] = {}
    for r in counted.groupBy("contenant_id", "jetons").agg(F.sum("m").alias("m")).toLocalIterator():
        histogram.setdefault(r["contenant_id"], {})[r["jetons"]] = r["m"]
    table = []
    for r in sizes:
        events, _ = pack_histogram(histogram.get(r["contenant_id"], {}), r["capacite"])
        table += [(int(r["contenant_id"]), *e) for e in events]
    table.sort()
    plan = np.array(table, dtype="int64").reshape(-1, 5)
    # one sortable number per (kind, length, rank): kinds and lengths are few, their index bounds the high digits
    heads, at = np.unique(plan[:, :2], axis=0, return_inverse=True)
    base, wide = int(plan[:, 3].max(initial=0)) + 1, MOST_CAPACITY + 1
    shared = spark.sparkContext.broadcast((plan, heads[:, 0] * wide + heads[:, 1], at.reshape(-1) * base + plan[:, 2], base, wide))

    @F.pandas_udf("long")
    def container(kind: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        plan, heads, starts, base, wide = shared.value
        if not len(kind):
            return pd.Series([], dtype="int64")
        ranks = rank.to_numpy("int64")
        mine = np.searchsorted(heads, kind.to_numpy("int64") * wide + length.to_numpy("int64"))
        found = plan[np.searchsorted(starts, mine * base + ranks, side="right") - 1]
        return pd.Series(np.where(found[:, 1] == 0, 0, found[:, 4] + ranks - found[:, 2]))

    before = Window.partitionBy("contenant_id", "jetons").orderBy("tas").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("contenant_id", "jetons", "tas", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("avant"))
    inside = Window.partitionBy("contenant_id", "jetons", "tas").orderBy("k", "morceau")
    ranked = items.withColumn("place", F.row_number().over(inside)).join(offsets, ["contenant_id", "jetons", "tas"])
    rank = F.col("avant") + F.col("place") - 1
    return ranked.select("contenant_id", container("contenant_id", F.col("jetons").cast("long"), rank).alias("conteneur"), F.col("k").alias(key), F.col("morceau").cast("int").alias("morceau"), "jetons")


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(contenant_id, capacite_tokens, conteneurs, jetons, remplissage): containers used and share of their space filled."""
    each = packed.groupBy("contenant_id", "conteneur").agg(F.sum("jetons").alias("j"))
    out = each.groupBy("contenant_id").agg(F.count("*").alias("conteneurs"), F.sum("j").alias("jetons"), F.max("j").alias("plus_plein"))
    out = out.join(containers.select("contenant_id", "capacite_tokens").distinct(), "contenant_id")
    return out.select("contenant_id", "capacite_tokens", "conteneurs", "jetons", "plus_plein", F.round(F.col("jetons") / (F.col("conteneurs") * F.col("capacite_tokens")), 6).alias("remplissage"))

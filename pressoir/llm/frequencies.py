"""Problem 6: frequency of every distinct term, by a distributed suffix array with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import BLANKS, clean_term, zone_counts

#: Separates the tokens of a suffix; sorts before every character of a token.
SEP = "\u0001"


def suffixes(df: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """Every suffix of every text: (suffix, record, poids), one row per token position.

    Tokens are runs of letters, digits and underscores in lower case. A suffix carries the
    ``longest`` tokens from its position on, enough to tell every n-gram up to that length; the text
    itself is read whole, and a key's texts are one record. Null keys, null and empty texts give no rows.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("record"), tokens.alias("t"))
    rows = rows.select("record", F.posexplode(F.transform("t", lambda _, i: F.array_join(F.slice(F.col("t"), i + 1, longest), SEP))).alias("pos", "suffix"))
    return rows.select("suffix", "record", F.lit(1).cast("long").alias("poids"))


def most_tokens(df: DataFrame, text: str) -> int:
    """The number of tokens of the longest text, at least 1: the length up to which there are n-grams."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return max(1, df.where(F.col(text).isNotNull()).agg(F.max(F.size(tokens))).first()[0] or 0)


def _prefix(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan a slice sorted by (record, suffix): for each suffix the common prefix, in tokens, with the one before of the same record; -1 at the start of the slice."""
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    last_record, last, started = None, [], False
    for batch in batches:
        shared = []
        for suffix, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            toks = suffix.split(SEP)
            shared.append(-1 if not started else _prefix(last, toks) if record == last_record else 0)
            last_record, last, started = record, toks, True
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.int32()), pa.array([piece] * len(shared), pa.int32())], names=["suffix", "record", "poids", "commun", "tranche"])


def within_records(suffix_rows: DataFrame) -> DataFrame:
    """(suffix, poids, commun): each suffix with the length of the prefix that it shares with its neighbour among its own record's sorted suffixes.

    Sorted by (record, suffix) in slices, so that a record may hold any share of the rows. What a slice's first suffix shares
    with the last of an earlier slice is settled on the driver, one row a slice.
    """
    spark = suffix_rows.sparkSession
    sliced = suffix_rows.repartitionByRange("record", "suffix").sortWithinPartitions("record", "suffix")
    rows = materialize(sliced.mapInArrow(_adjacent, "suffix string, record string, poids long, commun int, tranche int"), "suffixes")
    firsts = {r.tranche: (r.record, r.suffix) for r in rows.where("commun = -1").select("tranche", "record", "suffix").collect()}
    ends = {r.tranche: tuple(r.fin) for r in rows.groupBy("tranche").agg(F.max(F.struct("record", "suffix")).alias("fin")).collect()}
    settled, before = [], None
    for piece in sorted(firsts):
        record, suffix = firsts[piece]
        settled.append((piece, _prefix(before[1].split(SEP), suffix.split(SEP)) if before and before[0] == record else 0))
        before = ends[piece]
    edges = spark.createDataFrame(settled, "tranche int, bord int")
    out = rows.join(F.broadcast(edges), "tranche")
    return out.select("suffix", "poids", F.when(F.col("commun") < 0, F.col("bord")).otherwise(F.col("commun")).alias("commun"))


def _intervals(longest: int):
    """Scan one sorted slice of the suffix array; give partial counts of its n-grams.

    For each depth n the suffixes sharing their first n tokens are one interval of the array, and each of them is an occurrence. One that shares n tokens or more with
    its neighbour within its record is a within-record duplicate: it is subtracted from the record count. Both counts add up over the slices that an interval spans.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev: list[str] = []
        open_: list[list[int]] = []  # per depth of the last suffix: [occurrences, records]
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(open_) > depth:
                occurrences, records = open_.pop()
                out.append((SEP.join(prev[: len(open_) + 1]), len(open_) + 1, occurrences, records))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["gram", "n", "occurrences", "records"])

        for batch in batches:
            for suffix, weight, shared in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                toks = suffix.split(SEP)[:longest]
                close(_prefix(prev, toks))
                prev = toks
                open_ += [[0, 0] for _ in range(len(toks) - len(open_))]
                for depth, run in enumerate(open_):
                    run[0] += weight
                    run[1] += depth >= shared
                if len(out) > 20_000:
                    yield flush()
        close(0)
        yield flush()

    return scan


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The depth-1 scan over slices sorted by (term, record), vectorised.

    Where a suffix shares its one token with the one before, the common prefix is 1: the interval goes
    on. Where the record is the same too, it is a within-record duplicate and is subtracted.
    """
    import numpy as np
    import pyarrow.compute as pc

    last_term = last_record = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, record, weight = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        same_term = np.zeros(n, bool)
        same_record = np.zeros(n, bool)
        same_term[0] = term[0].as_py() == last_term
        same_record[0] = same_term[0] and record[0].as_py() == last_record
        if n > 1:
            same_term[1:] = pc.equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same_record[1:] = same_term[1:] & pc.equal(record.slice(1), record.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        last_term, last_record = term[n - 1].as_py(), record[n - 1].as_py()
        starts = np.flatnonzero(~same_term)
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        occ = np.add.reduceat(weight, starts)
        rec = np.add.reduceat((~same_record).astype("int64"), starts)
        yield pa.RecordBatch.from_arrays([term.take(pa.array(starts)), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names=["gram", "occurrences", "records"])


def gram_frequencies(suffix_rows: DataFrame, longest: int) -> DataFrame:
    """(gram, n, occurrences, records) of every n-gram of 1 to ``longest`` tokens.

    The suffixes are range-partitioned and sorted: together the partitions are the suffix
    array. Each is scanned once for its common-prefix intervals; partial counts are
    summed. What is subtracted within records comes from ``within_records``; with ``longest`` = 1 the array is sorted by (term, record), a record's equal
    suffixes lie side by side in one slice, and duplicates are subtracted as they are met. Tokens of a gram are parted by a blank.
    """
    if longest == 1:
        array = suffix_rows.repartitionByRange("suffix", "record").sortWithinPartitions("suffix", "record")
        part = array.mapInArrow(_unigrams, "gram string, occurrences long, records long")
        return part.groupBy("gram").agg(F.lit(1).alias("n"), F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    array = within_records(suffix_rows).repartitionByRange("suffix").sortWithinPartitions("suffix")
    part = array.mapInArrow(_intervals(longest), "gram string, n int, occurrences long, records long")
    out = part.groupBy("gram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return out.withColumn("gram", F.translate("gram", SEP, " "))


def term_frequencies(counts: DataFrame, stop_list: DataFrame | None = None, rare: int = 3, common: float = 0.5) -> DataFrame:
    """(mot, occurrences, articles, marque) of every term of a count table and of a stop-list.

    ``counts`` is read by ``zone_counts`` (see there for nulls and repeated rows): each of
    its rows is a suffix of one token that stands for tf occurrences in one zone of its record; the same term in another zone lies next to it in the array and is subtracted from the record count. marque is 'rare' where fewer than
    ``rare`` records hold the term (none included), 'commun' where more than the share
    ``common`` of all records do, else null; a term for which both hold, possible with fewer than six records, gets two rows.
    Stop-list entries that are null or blank are ignored.
    """
    cells = zone_counts(counts).select(F.col("mot").alias("suffix"), F.col("document_id").alias("record"), F.col("tf").alias("poids"))
    freq = gram_frequencies(cells, 1).select(F.col("gram").alias("mot"), "occurrences", F.col("records").alias("articles"))
    if stop_list is not None:
        stops = stop_list.select(clean_term(F.col("mot")).alias("mot")).where(F.col("mot") != "").distinct()
        freq = freq.unionByName(stops.select("mot", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("articles")))
        freq = freq.groupBy("mot").agg(F.sum("occurrences").alias("occurrences"), F.sum("articles").alias("articles"))
    docs = counts.where(F.col("document_id").isNotNull() & (F.btrim(F.col("mot"), F.lit(BLANKS)) != "")).agg(F.countDistinct("document_id")).first()[0]
    marks = F.array_compact(F.array(F.when(F.col("articles") < rare, F.lit("rare")), F.when(F.col("articles") > common * docs, F.lit("commun"))))
    return freq.select("mot", "occurrences", "articles", F.explode_outer(marks).alias("marque"))

"""Session helpers: shared scratch folder, materialised stages, skew-proof joins."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset on one machine (tests) an own temporary
    folder is made and remembered for the session. On a cluster it must be set: RuntimeError.
    """
    named = spark.conf.get(SCRATCH_CONF, None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {SCRATCH_CONF} to a folder that all executors share")
    own = spark.conf.get("spark.pressoir.scratch", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="pressoir-")
        spark.conf.set("spark.pressoir.scratch", own)
    return own


def until_exit(spark: SparkSession, path: str) -> str:
    """Have a written path removed when the driver's JVM ends; the path itself."""
    jvm = spark._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, is column-pruned by later readers
    and gives the planner true sizes, so that joins with it broadcast only what is small. Removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


def spread(df: DataFrame, times: int = 3) -> DataFrame:
    """A scan that Python workers will read, in at least ``times`` partitions a core.

    Compressed text is small on disk and costly to read in Python: a scan is cut by its bytes, which may leave most
    cores idle. Scans of enough partitions are left as they are.
    """
    least = times * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def hash_sample(df: DataFrame, text: str, most: int) -> DataFrame:
    """(text): at most ``most`` distinct values, those of least hash; the same for the same values, however often each is repeated.

    Each task keeps its ``most`` least hashes, and only these are shuffled to find the bound; then each value below it is kept once.
    """

    def least_of_task(batches):
        kept = np.empty(0, "int64")
        for pdf in batches:
            kept = np.unique(np.concatenate([kept, pdf["h"].to_numpy("int64")]))[:most]
        yield pd.DataFrame({"h": kept})

    h = F.xxhash64(text)
    rows = df.where(F.col(text).isNotNull())
    least = rows.select(h.alias("h")).mapInPandas(least_of_task, "h long").distinct().orderBy("h").limit(most)
    bound = least.agg(F.max("h")).first()[0]
    kept = rows.where(h <= F.lit(bound) if bound is not None else F.lit(False))
    return kept.select(h.alias("h"), text).groupBy("h").agg(F.first(text).alias(text)).orderBy("h").select(text)


#: Keys that hold more than 1/HEAVY_SHARE of all rows are joined by broadcast; there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 500


def join_margin(left: DataFrame, right: DataFrame, key: str | list[str], weight: Column, total: float, how: str = "inner") -> DataFrame:
    """Inner or left join of many rows with one row per key, whatever the skew of the key.

    ``weight`` (a column of ``right``) is the number of rows of ``left`` under the key, ``total``
    their sum. Keys of more than total/HEAVY_SHARE rows number fewer than HEAVY_SHARE, so that
    part of ``right`` is broadcast under a proven bound; all other keys are shuffled, and
    none of them fills a partition.
    """
    keys = [key] if isinstance(key, str) else key
    is_heavy = F.coalesce(weight > F.lit(total / HEAVY_SHARE), F.lit(False))
    heavy = right.where(is_heavy)
    if heavy.limit(1).count() == 0:
        return left.join(right, keys, how)
    hot = left.join(F.broadcast(heavy), keys)
    cold = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right.where(~is_heavy), keys, how)
    return hot.unionByName(cold)

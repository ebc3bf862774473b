"""Canonical schema of an archive, and the view of the driver's tables as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("legende", T.StringType())])
DOCUMENT = T.StructType(
    [T.StructField("fichier", T.StringType()), T.StructField("numero", T.StringType()), T.StructField("date", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("rubrique", "titre", "auteur", "contact", "texte")]
    + [T.StructField("images", T.ArrayType(IMAGE))]
)
COLUMNS = DOCUMENT.fieldNames()
ZONES = ("titre", "texte", "legendes")


def check_keys(docs: DataFrame) -> DataFrame:
    """(probleme, fichier, lignes) of rows that break the key: null or repeated ``fichier``."""
    groups = docs.groupBy("fichier").agg(F.count("*").alias("lignes"))
    kind = F.when(F.col("fichier").isNull(), F.lit("cle nulle")).when(F.col("lignes") > 1, F.lit("cle repetee"))
    return groups.select(kind.alias("probleme"), "fichier", "lignes").where("probleme is not null")


#: Columns that tell rows of one key and time apart, before any others.
TIES = ("numero", "date_pub", "rubrique", "titre")


def latest(rows: DataFrame, key: str = "fichier", by: str = "recu_le", columns: list[str] | None = None) -> DataFrame:
    """The last delivered row of each key, null orders first, with the wanted columns; rows equal in the order are told apart by TIES, then by the other wanted columns.

    Which keys were delivered more than once is found on (key, order) alone. Rows of all other keys are passed through by an anti-join, so whole texts meet
    no aggregate; of the contested keys only the rows of the last order are compared, by a maximum taken on the map side first.
    """
    wanted = [c for c in (columns or rows.columns) if c not in (key, by)]
    ties = [c for c in TIES if c in rows.columns and c not in (key, by)]
    order = [*ties, *[c for c in wanted if c not in ties]]
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"), F.max(by).alias("_dernier")).where("_n > 1")
    contested = counts.select(F.col(key).alias("_cle"), "_dernier")
    same = F.col(key).eqNullSafe(F.col("_cle"))
    slim = rows.select(key, by, *wanted)
    sole = slim.join(contested.select("_cle"), same, "left_anti")
    again = rows.select(key, by, *order).join(contested, same & F.col(by).eqNullSafe(F.col("_dernier"))).groupBy(key).agg(F.max(F.struct(by, *order)).alias("_r"))
    return sole.unionByName(again.select(key, "_r.*").select(key, by, *wanted))


def archive(spark: SparkSession, folder: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The articles of a folder of tables as an archive: one row per ``fichier``, the last delivered, with the wanted columns only."""
    rows = spark.read.parquet(f"{folder}/articles.parquet").where("fichier is not null")
    names = {"date": "date_pub"}
    stored = [names.get(c, c) for c in columns if c != "fichier"]
    return latest(rows, columns=["fichier", *stored]).select("fichier", *[F.col(names.get(c, c)).alias(c) for c in columns if c != "fichier"])


def zone_column(zone: str, captions: str = "") -> Column:
    """The text of one zone; null texts are empty, captions are joined by ``captions`` (nothing by default)."""
    if zone == "legendes":
        return F.array_join(F.transform(F.coalesce("images", F.array().cast(T.ArrayType(IMAGE))), lambda x: F.coalesce(x["legende"], F.lit(""))), captions)
    return F.coalesce(zone, F.lit(""))


def zones(docs: DataFrame, captions: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents with their three text zones, and the columns to keep."""
    return docs.select("fichier", *keep, *[zone_column(z, captions).alias(z) for z in ZONES])


#: Columns that a zone is read from.
SOURCES = {"titre": "titre", "texte": "texte", "legendes": "images"}


def zoned_archive(spark: SparkSession, folder: str, wanted: tuple[str, ...] = ZONES) -> DataFrame:
    """The archive with what the wanted zones are read from."""
    return archive(spark, folder, ("fichier", *[SOURCES[z] for z in ZONES if z in wanted]))


def read_zones(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(fichier, zone, contenu), one row per document and wanted zone; all zones by default. Other zones' columns are not read."""
    names = [z for z in ZONES if wanted is None or z in wanted]
    pairs = F.array(*[F.struct(F.lit(z).alias("zone"), zone_column(z).alias("contenu")) for z in names]) if names else F.array().cast("array<struct<zone:string,contenu:string>>")
    return docs.select("fichier", F.explode(pairs).alias("z")).select("fichier", "z.zone", "z.contenu")

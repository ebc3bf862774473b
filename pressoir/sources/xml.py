"""The archive as XML, and a report of how XML rows conform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_slash_date
from ..schema import COLUMNS

ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in COLUMNS if n != "images"]
    + [T.StructField("images", T.StructType([T.StructField("image", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("legende", T.StringType())])))]))]
)


def rename(df: DataFrame, tags: dict[str, str] | None) -> DataFrame:
    """Columns renamed by a dictionary of field to tag."""
    return df.withColumnsRenamed(tags or {})


def write(docs: DataFrame, path: str, tags: dict[str, str] | None = None) -> None:
    """One ``bulletin`` per document under ``corpus``; null fields are left out, dates are dd/mm/yyyy, images stand in a container."""
    out = docs.withColumn("date", F.date_format("date", "dd/MM/yyyy")).withColumn("images", F.when(F.size("images") > 0, F.struct(F.col("images").alias("image"))))
    rename(out, tags).write.format("xml").option("rootTag", "corpus").option("rowTag", "bulletin").mode("overwrite").save(path)


def read(spark: SparkSession, path: str, tags: dict[str, str] | None = None) -> DataFrame:
    """Documents of an XML archive: dates dd/mm/yyyy, else ISO, else null; empty fields are null."""
    tags = tags or {}
    schema = T.StructType([T.StructField(tags.get(f.name, f.name), f.dataType) for f in ROW])
    rows = spark.read.format("xml").option("rowTag", "bulletin").schema(schema).load(path)
    rows = rows.withColumnsRenamed({v: k for k, v in tags.items()})
    date = F.coalesce(F.try_to_timestamp("date", F.lit("dd/MM/yyyy")), F.try_to_timestamp("date"))
    text = [F.nullif(F.col(n), F.lit("")).alias(n) for n in COLUMNS if n not in ("date", "images")]
    images = F.coalesce("images.image", F.array().cast("array<struct<url:string,legende:string>>"))
    images = F.transform(images, lambda x: F.struct(F.nullif(x["url"], F.lit("")).alias("url"), F.nullif(x["legende"], F.lit("")).alias("legende")))
    return rows.select(*text, date.alias("date"), images.alias("images")).select(*COLUMNS)


def quality_report(rows: DataFrame, mandatory: tuple[str, ...] = ("numero", "date", "rubrique", "titre", "texte")) -> DataFrame:
    """(fichier, niveau, regle) of every rule that a row breaks: 'erreur' for missing mandatory fields and malformed dates, 'avertissement' for images without
    url or caption. ``date`` is text dd/mm/yyyy or a timestamp."""
    is_text = dict(rows.dtypes)["date"] == "string"
    rule = lambda level, name, broken: F.when(broken, F.struct(F.lit(level).alias("niveau"), F.lit(name).alias("regle")))
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rules = [rule("erreur", f"{c} manquant", empty(c)) for c in mandatory]
    if is_text:
        rules.append(rule("erreur", "date mal formee", F.col("date").isNotNull() & ~is_slash_date("date")))
    some = lambda f: F.coalesce(F.exists("images", lambda x: F.coalesce(x[f] == "", F.lit(True))), F.lit(False))
    rules += [rule("avertissement", "image sans url", some("url")), rule("avertissement", "image sans legende", some("legende"))]
    return rows.select("fichier", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("fichier", "r.niveau", "r.regle")

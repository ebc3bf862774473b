"""Tab-separated exports and imports of dictionaries, metrics and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postings import frequency_lines


#: Outer blanks are part of a word.
BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Null is an empty field, the empty string a quoted pair; a backslash is a backslash."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("emptyValue", '""').option("nullValue", "").options(**BLANKS).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Text stays text: words spelled like markers of missing values are words."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("emptyValue", "").option("nullValue", "\u0000").options(**BLANKS).csv(path)


def write_stop_list(stops: DataFrame, path: str) -> None:
    """Lines of a word and a quoted pair, without header."""
    write_tsv(stops.select("mot", F.lit("").alias("remplacement")).orderBy("mot"), path, header=False)


def read_substitutions(spark: SparkSession, path: str) -> DataFrame:
    """(mot, remplacement) of a two-column file without header; a missing replacement is empty."""
    return read_tsv(spark, path, "mot string, remplacement string", header=False).select("mot", F.coalesce("remplacement", F.lit("")).alias("remplacement"))


def add_learned(dictionary: DataFrame, learned: DataFrame) -> DataFrame:
    """A dictionary (mot, racine) with learned entries for words it lacks; write it to a new path."""
    return dictionary.unionByName(learned.join(dictionary.select("mot"), "mot", "left_anti").dropDuplicates(["mot"]))


def write_wide_index(postings: DataFrame, path: str, width: int = 256) -> None:
    """token, id_1 .. id_width, padded with nothing; a token of more documents has several lines."""
    rows = postings.select("token", "fichier").distinct()
    sizes = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > width // 2)
    line = F.coalesce(F.pmod(F.xxhash64("fichier"), F.ceil(F.col("n") / (width // 2))), F.lit(0))
    lists = rows.join(sizes, "token", "left").groupBy("token", line.alias("ligne")).agg(F.sort_array(F.collect_list("fichier")).alias("ids"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / width).cast("int")), lambda i: F.slice("ids", i * width + 1, F.lit(width)))
    lines = lists.select("token", F.explode(cut).alias("ids"))
    write_tsv(lines.select("token", *[F.get("ids", F.lit(i)).alias(f"id_{i + 1}") for i in range(width)]), path)


def read_wide_index(spark: SparkSession, path: str) -> DataFrame:
    """(token, fichier) of a wide index; padding is left out."""
    lines = spark.read.option("sep", "\t").option("header", True).csv(path)
    ids = [c for c in lines.columns if c != "token"]
    rows = lines.select("token", F.explode(F.array(*[F.col(c) for c in ids]) if ids else F.array().cast("array<string>")).alias("fichier"))
    return rows.where((F.col("fichier") != "") & F.col("fichier").isNotNull())


def write_postings(postings: DataFrame, path: str) -> None:
    """The index for search: Parquet, a folder per zone, in ranges of (token, fichier), so that a token's rows lie in few row groups and a hot token fills no file."""
    postings.repartitionByRange("zone", "token", "fichier").sortWithinPartitions("zone", "token", "fichier").write.mode("overwrite").partitionBy("zone").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(zone, token, fichier) of a written index; filters on zone choose folders, filters on token row groups."""
    return spark.read.schema("token string, fichier string, zone string").parquet(path).select("zone", "token", "fichier")


def read_frequency_index(spark: SparkSession, path: str) -> DataFrame:
    """(champ, terme, document_id, tf) of a written frequency index."""
    lines = spark.read.schema("terme string, lot int, documents string, champ string").option("sep", "\t").options(**BLANKS).csv(path)
    pairs = lines.select("champ", F.coalesce("terme", F.lit("")).alias("terme"), F.explode(F.split("documents", " ")).alias("p"))
    return pairs.select("champ", "terme", F.regexp_extract("p", "^(.*):", 1).alias("document_id"), F.regexp_extract("p", ":([0-9]+)$", 1).cast("long").alias("tf"))


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """(mot, lemme, racine) of a written comparison."""
    return spark.read.schema("mot string, lemme string, racine string").option("header", True).csv(path)


def write_frequency_index(frequencies: DataFrame, path: str) -> None:
    """'term<TAB>doc:freq doc:freq' lines, terms and documents sorted, a folder per field."""
    frequency_lines(frequencies).orderBy("champ", "terme").write.mode("overwrite").partitionBy("champ").option("sep", "\t").options(**BLANKS).csv(path)


def write_comparison(stems: DataFrame, lemmas: DataFrame, path: str) -> None:
    """mot, lemme, racine per word, deduplicated and sorted."""
    both = lemmas.withColumnRenamed("racine", "lemme").join(stems, "mot", "full").dropDuplicates(["mot"]).orderBy("mot")
    both.write.mode("overwrite").option("header", True).csv(path)

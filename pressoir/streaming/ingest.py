"""Pages that arrive in a folder, ingested as a stream into the archive's table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.html import bulletin, extract

FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str = "*.htm", parser=bulletin) -> StreamingQuery:
    """Each new file once: extracted and appended as Parquet; the checkpoint remembers what was read, so a restart repeats nothing."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(folder)
    docs = extract(files.select("path", F.decode("content", "UTF-8").alias("html")), parser=parser)
    return docs.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

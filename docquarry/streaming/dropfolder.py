"""A folder of arriving PDF files as a stream into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources import pdf


def arriving(spark: SparkSession, path: str, *, glob: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """Streaming (file_id, path, arrived, content) of new files."""
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger)
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = source.schema(schema).load(path)
    return found.select(F.xxhash64("path").alias("file_id"), "path", F.col("modificationTime").alias("arrived"), "content")


def into_tables(stream: DataFrame, out: str, tables: tuple[str, ...] = ("files", "objects", "edges"), *, checkpoint: str):
    """Start the query: each batch is parsed once per table and appended as Parquet under its batch number, so a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        for table in tables:
            pdf.parsed(batch, table).write.mode("overwrite").parquet(f"{out}/{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, *, within: str = "7 days") -> DataFrame:
    """Files whose bytes were not seen within the time; state is dropped behind the watermark."""
    return stream.withColumn("sha256", F.sha2("content", 256)).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["sha256"])


def event_counts(stream: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per type and event-time window, late ones up to the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

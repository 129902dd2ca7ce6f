"""Streams: detection and masking are projections, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.detect import detect
from ..operators.engine import redact_files
from ..operators.mask import redact
from ..sources.ingest import format_of, kind_of


def read(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def read_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(path, content, kind, format) of files of any kind as they arrive, each once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).load(folder).select("path", "content")
    return files.withColumn("kind", kind_of(F.col("path"), F.col("content"))).withColumn("format", format_of(F.col("path")))


def write_files(files: DataFrame, folder: str, checkpoint: str, output: str = "markdown", **options) -> DataStreamWriter:
    """Files of any kind redacted as they arrive (options are redact_files'), without their contents; start() it.

    Each batch is a folder of Parquet named by its number and written whole, so a batch that is repeated after a failure takes
    its own place: no file's result is lost or doubled.
    """

    def batch(rows: DataFrame, number: int) -> None:
        redact_files(rows, output, **options).drop("content").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def redacted_stream(docs: DataFrame, text_col: str = "text", entities: list[str] | None = None, score_threshold: float | None = None) -> DataFrame:
    """The stream with masked text in place of the original and the entities found, without matched text."""
    return redact(docs, text_col, entities, score_threshold).withColumn(text_col, F.col("redacted")).drop("redacted")


def counts_by_window(docs: DataFrame, id_cols: list[str], time_col: str, window: str = "5 minutes", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Entities by type and window of event time; rows later than `late` behind the newest are left out."""
    seen = detect(docs.withWatermark(time_col, late), [*id_cols, time_col], text_col)
    return seen.groupBy(F.window(time_col, window), "entity_type").agg(F.count("*").alias("n"))


def write(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """An append-only Parquet sink that resumes from its checkpoint; start() it."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)

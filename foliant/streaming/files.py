"""Streams of document files: new files below a folder become node rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.documents import paragraphs, raw_documents

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_trigger).load(path)
    return raw_documents(files.withColumn("doc_id", F.col("path")))


def stream_paragraphs(spark: SparkSession, path: str, **options) -> DataFrame:
    return paragraphs(stream_documents(spark, path), **options)

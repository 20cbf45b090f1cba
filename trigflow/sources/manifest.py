"""File listings and small text files from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below a root; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole small files such as metadata."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

"""Recorded responses as input: one file is one response, its name the route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """route (file name without suffix) and body of every recorded response."""
    read = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    return read.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("route"), "body")


def binaries(spark: SparkSession, folder: str, most_bytes: int) -> DataFrame:
    """path, bytes and digest of downloaded files; those over the limit have error too_large and no bytes."""
    read = spark.read.format("binaryFile").load(folder)
    fits = F.col("length") <= most_bytes
    return read.select("path", "length", F.when(fits, F.col("content")).alias("content"), F.when(fits, F.sha2("content", 256)).alias("digest"), F.when(~fits, "too_large").alias("error"))

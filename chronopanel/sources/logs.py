"""Reading run logs, heartbeats and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What starts a heartbeat line in a job log, and the layout of the tables.
HEARTBEAT_MARKER = "___HEARTBEAT___:"
HEARTBEAT_SCHEMA = "time bigint, heartbeat bigint"
METRIC_SCHEMA = "key string, pid string, time timestamp, value double"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value and file: the lines of text logs."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def read_scripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value and file: one whole script per row."""
    return spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def read_heartbeats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with header: time in nanoseconds, number of the heartbeat."""
    return spark.read.schema(HEARTBEAT_SCHEMA).option("header", True).csv(path)


def heartbeats_in(lines: DataFrame, text: str = "value") -> DataFrame:
    """The same table out of the lines of a job log; other columns, such as the file, stay."""
    others = [F.col(c) for c in lines.columns if c != text]
    fields = F.split(F.get(F.split(F.col(text), ":"), F.lit(1)), ",")
    return lines.where(F.col(text).contains(HEARTBEAT_MARKER)).select(
        *others,
        F.trim(F.get(fields, F.lit(0))).try_cast("bigint").alias("time"),
        F.trim(F.get(fields, F.lit(1))).try_cast("bigint").alias("heartbeat"),
    )


def read_metrics(spark: SparkSession, path: str | list[str], format: str = "parquet") -> DataFrame:
    """key, pid, time, value of metric samples, as Parquet or CSV with header."""
    reader = spark.read.schema(METRIC_SCHEMA)
    return reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)

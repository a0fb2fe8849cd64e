"""Archived raw responses: ``{root}/{chain}/{yyyyMMdd'T'HHmmss'Z'}/{scope}_p{page}.json|html``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"/([^/]+)/(\d{8}T\d{6}Z)/([^/]*)_p(\d+)\.(json|html)$"


def from_path(path: Column) -> list[Column]:
    """chain, run_ts, scope, page and format of a file; null where the path is not one of an archive."""
    part = lambda i: F.nullif(F.regexp_extract(path, NAME, i), F.lit(""))
    ts = F.regexp_replace(part(2), "[TZ]", "")
    # Spaces and the like are encoded in paths.
    return [part(1).alias("chain"), F.try_to_timestamp(ts, F.lit("yyyyMMddHHmmss")).alias("run_ts"), F.url_decode(F.regexp_replace(part(3), r"\+", "%2B")).alias("scope"), part(4).cast("int").alias("page"), part(5).alias("format")]


def read_raw_archive(spark: SparkSession, root: str) -> DataFrame:
    """(payload, chain, run_ts, scope, page, format) of every archived file, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    rows = files.withColumn("path", F.input_file_name())
    return rows.select(F.col("value").alias("payload"), *from_path(F.col("path"))).where("chain is not null")


def archive_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, chain, run_ts, scope, page, format) of every archived file: a listing, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select("path", "length", *from_path(F.col("path"))).where("chain is not null")


def read_retained(spark: SparkSession, root: str, now: datetime, days: int = 7) -> DataFrame:
    """As ``read_raw_archive``, of the runs of the last days alone: they are chosen from the listing, and only their folders are read."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    # Two runs a day and chain, so these are few.
    folders = sorted(r.folder for r in retained_runs(archive_files(spark, root), now, days).select(folder.alias("folder")).distinct().collect())
    if not folders:
        return read_raw_archive(spark, root).where("false")
    files = spark.read.text(folders, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.col("value").alias("payload"), *from_path(F.col("path"))).where("chain is not null")


def retained_runs(df: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Rows of runs within the last days, the boundary kept."""
    return df.where(F.col("run_ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))

"""Shared pieces: reading tables, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII whitespace of the contracts, as a Java pattern and as a list of bytes.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings that keep memory and disk bounded.

    Arrow batches stay small because texts may be long; the shuffle files of a finished query go at
    once instead of when the driver happens to collect its garbage.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, or where none is named one in the warehouse, which they share as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/scratch").rstrip("/")


class Scratch:
    """Tables written once under the shared folder and read back: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t", dictionary: bool = True) -> DataFrame:
        """``df``, written; without dictionaries where nearly all values differ, as those of hashes."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(col) -> "F.Column":
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (id, comp), comp the smallest id of the component.

    Alternating large-star and small-star rounds: each node links its larger neighbours, then all its
    neighbours, to its smallest one. The number of edges never grows and a logarithmic number of rounds
    suffices; every round is a written table. Nodes without edges have no row.
    """
    e = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("s"))
            .select(F.col("s.x").alias("u"), F.col("s.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = scratch.keep(small, "edges")
        # A fixed point is reached when every node has one edge, and no root has an edge of its own; one query tells both.
        ends = new.select(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(False).alias("root")).union(new.select("v", F.lit(0), F.lit(True)))
        busy = ends.groupBy("x").agg(F.sum("own").alias("own"), F.max("root").alias("root")).where("own > 1 or (own > 0 and root)").limit(1).count()
        scratch.drop(e)
        e = new
        if not busy:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )

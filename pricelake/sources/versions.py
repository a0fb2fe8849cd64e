"""Tables in partitions that are rewritten one by one, under one pointer.

A change writes the partitions that it touches to folders of its own version, then a manifest that names, for
every partition of every table, the version that holds it. The manifest counts once its _SUCCESS file is there,
so readers see all of a change or nothing of it, and a change that fails leaves the last version as it is. What is
written twice after a failure goes to the same folders.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, part string, version long, note string"


def part_of(key: Column) -> Column:
    """The folder of a key: safe as a name of a file."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def part_name(key: str | None) -> str:
    return hashlib.md5((key or "").encode()).hexdigest()


@dataclass
class Version:
    """A number, and for each (table, partition) the version that holds it; ``notes`` are the writer's own."""

    number: int = 0
    held: dict[tuple[str, str], int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        at = self.path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def current(self) -> Version:
        """The last version that is complete; number 0, without tables, where none is."""
        done = [int(n) for n in self.names(f"{self.root}/manifest") if n.isdigit() and self.fs.exists(self.path(f"{self.root}/manifest/{n}/_SUCCESS"))]
        if not done:
            return Version()
        # One row a partition of a table, of which there are few.
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{max(done)}").collect()
        return Version(max(done), {(r.name, r.part): r.version for r in rows if r.note is None}, {r.part: r.note for r in rows if r.note is not None})

    def folder(self, name: str, part: str, number: int) -> str:
        return f"{self.root}/{name}/version={number}/part={part}"

    def read(self, version: Version, name: str, schema: str, parts: list[str] | None = None) -> DataFrame:
        """A table's partitions, all of them or those named."""
        paths = [self.folder(name, p, n) for (t, p), n in sorted(version.held.items()) if t == name and (parts is None or p in parts)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, name: str, key: str, number: int) -> list[str]:
        """Write partitions of a table for a version to come; returns those that have rows."""
        path = f"{self.root}/{name}/version={number}"
        df.withColumn("part", part_of(F.col(key))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        return [n.removeprefix("part=") for n in self.names(path) if n.startswith("part=")]

    def commit(self, version: Version) -> None:
        rows = [(t, p, n, None) for (t, p), n in version.held.items()] + [("", k, version.number, v) for k, v in version.notes.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version.number}")

    def prune(self, keep: int = 2) -> None:
        """Delete all but the last manifests, and folders of partitions that none of these names."""
        done = sorted(int(n) for n in self.names(f"{self.root}/manifest") if n.isdigit())
        last = [n for n in done if self.fs.exists(self.path(f"{self.root}/manifest/{n}/_SUCCESS"))][-keep:]
        if not last:
            return
        held = {(r.name, r.part, r.version) for n in last for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{n}").collect() if r.note is None}
        for name in {t for t, _, _ in held}:
            for v in (n for n in self.names(f"{self.root}/{name}") if n.startswith("version=") and int(n[8:]) <= last[-1]):
                for p in (n[5:] for n in self.names(f"{self.root}/{name}/{v}") if n.startswith("part=")):
                    if (name, p, int(v[8:])) not in held:
                        self.fs.delete(self.path(f"{self.root}/{name}/{v}/part={p}"), True)
        for n in done:
            if n < last[0]:
                self.fs.delete(self.path(f"{self.root}/manifest/{n}"), True)


def replace_parts(spark: SparkSession, root: str, name: str, df: DataFrame, key: str = "store_id") -> int:
    """Rewrite the partitions of a table that ``df`` has rows of, all others stay; the number of the new version."""
    v = Versions(spark, root)
    now = v.current()
    number = now.number + 1
    written = v.write(df, name, key, number)
    v.commit(Version(number, now.held | {(name, p): number for p in written}, now.notes))
    return number


def read_parts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    v = Versions(spark, root)
    return v.read(v.current(), name, schema)

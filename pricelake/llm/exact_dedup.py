"""Exact deduplication of incoming texts against immutable snapshots.

Each snapshot is a set of text digests, cut by digest into shards. A shard carries a static binary-fuse
filter (three slots in neighbouring segments, 8-bit fingerprints, built once, never changed). Incoming
digests are first grouped among themselves, so a text that fills a third of the batch is one row from
then on. The distinct digests are screened by the filter of their shard; only positives join the
snapshot's exact bucket, where whole texts are compared byte by byte.

Defined cases: a null text is an empty text; empty texts equal each other; repeated rows (same id) count
as rows; ties cannot arise because the largest id stays; an empty side gives no matches; columns other
than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, table, tune
from .kernel import U, mix

#: Digests of one shard: 16 MB of hashes at most in one task, 1.2 MB of filter.
SHARD_ROWS = 1_000_000


def fuse_shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments for n distinct keys."""
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))) + 8
    return segment, max(3, -(-room // segment) + 2)


def fuse_slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots and the fingerprint of each key."""
    h = mix(keys ^ mix(np.full(1, seed + 1, U)))
    first = ((h >> U(32)) * U(segments - 2)) >> U(32)
    low = U(segment - 1)
    a = first * U(segment) + (h & low)
    b = (first + U(1)) * U(segment) + ((h >> U(18)) & low)
    g = mix(h + U(0x9E3779B97F4A7C15))
    c = (first + U(2)) * U(segment) + (g & low)
    return np.stack((a, b, c)).astype(np.int64), ((g >> U(56)) & U(255)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, fingerprints) of a filter that holds all the distinct keys.

    Peels, a round at a time, all keys that are alone in some slot; retries with another seed where a
    core remains.
    """
    keys = np.unique(keys)
    segment, segments = fuse_shape(len(keys))
    for seed in range(64):
        slots, print_ = fuse_slots(keys, seed, segment, segments)
        size = segment * segments
        degree = np.bincount(slots.ravel(), minlength=size)
        index = np.arange(len(keys), dtype=np.int64)
        who = np.zeros(size, np.int64)
        for s in slots:
            np.bitwise_xor.at(who, s, index)
        rounds, left = [], len(keys)
        while True:
            single = np.flatnonzero(degree == 1)
            if not len(single):
                break
            key, at = np.unique(who[single], return_index=True)
            own = single[at]
            rounds.append((key, own))
            left -= len(key)
            for s in slots:
                np.subtract.at(degree, s[key], 1)
                np.bitwise_xor.at(who, s[key], key)
        if left == 0:
            cell = np.zeros(size, np.uint8)
            for key, own in reversed(rounds):  # within a round no key's own slot is another's, later rounds are set
                three = slots[:, key]
                cell[own] = 0
                cell[own] = print_[key] ^ cell[three[0]] ^ cell[three[1]] ^ cell[three[2]]
            return seed, segment, segments, cell.tobytes()
        segments += 1 + segments // 20
    raise RuntimeError("no filter after 64 seeds")


def fuse_contains(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    cell = np.frombuffer(cells, np.uint8)
    (a, b, c), print_ = fuse_slots(keys, seed, segment, segments)
    return (cell[a] ^ cell[b] ^ cell[c]) == print_


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest: sha-256 of the normalised text as hex, key: 64 bits of it)."""
    return docs.select("doc_id", F.sha2(lower_ascii(F.col("text")), 256).alias("digest"))


def keyed(df: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return df.withColumn("key", key).withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))


def snapshot_filters(snapshot_digests: DataFrame, shards: int) -> DataFrame:
    """One filter a shard of an immutable snapshot: (shard, seed, segment, segments, cells)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, cells = fuse_build(pdf["key"].to_numpy().view(U))
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), seed, segment, segments, cells)], columns=["shard", "seed", "segment", "segments", "cells"])

    rows = keyed(snapshot_digests.select("digest").distinct(), shards).select("shard", "key")
    return rows.groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, segments int, cells binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct incoming digests that a snapshot may hold: all that it holds, and about 0.4 % of the others."""

    def probe(rows: pd.DataFrame, fuse: pd.DataFrame) -> pd.DataFrame:
        if not len(fuse) or not len(rows):
            return rows.iloc[:0][["digest"]]
        f = fuse.iloc[0]
        hit = fuse_contains(rows["key"].to_numpy().view(U), int(f.seed), int(f.segment), int(f.segments), f.cells)
        return rows.loc[hit, ["digest"]]

    return (
        keyed(incoming.select("digest").distinct(), shards)
        .groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInPandas(probe, "digest string")
    )


def exact_dedup(spark: SparkSession, incoming: DataFrame, snapshots: list[DataFrame], scratch: Scratch | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Assign each row of ``incoming`` and of the snapshots (doc_id, text) the row of its text that stays.

    Returns (doc_id, keep_id, group_size, kept, text_sha256, batch): batch is the snapshot's position, or
    the number of snapshots for incoming rows. The largest doc_id of equal texts stays.
    """
    tune(spark)
    scratch = scratch or Scratch(spark, "exact-dedup")
    batches = [*snapshots, incoming]
    new = len(snapshots)
    rows = [scratch.keep(digests(b).withColumn("batch", F.lit(i)), "digests") for i, b in enumerate(batches)]
    fresh = rows[new].groupBy("digest").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    confirmed, incoming_rows = None, rows[new].count()
    for i in range(new):
        # Shards bound what one task holds of either side.
        count = max(rows[i].count(), incoming_rows)
        shards = max(1, -(-count // shard_rows), spark.sparkContext.defaultParallelism if count > 100_000 else 1)
        positives = screen(fresh, snapshot_filters(rows[i], shards), shards)
        same = scratch.keep(byte_checked(batches[i], rows[i], batches[new], rows[new], positives), "same")
        confirmed = same if confirmed is None else confirmed.union(same)
    # Groups of each batch, then of all batches: what a byte check confirms shares one group with it.
    groups = fresh.withColumn("batch", F.lit(new))
    for i in range(new):
        old = rows[i].groupBy("digest").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).withColumn("batch", F.lit(i))
        groups = groups.union(old)
    if confirmed is None:
        total = groups.select("digest", "top", "n", "batch")
    else:
        joined = confirmed.select("digest").distinct().withColumn("shared", F.lit(True))
        # Digests that only lie in snapshots share a group with equal ones of other snapshots as well.
        total = groups.join(joined, "digest", "left").select("digest", "top", "n", "batch", F.coalesce("shared", F.lit(False)).alias("shared"))
        total = total.withColumn("part", F.when(F.col("shared") | (F.col("batch") < new), F.lit(0)).otherwise(F.lit(1))).drop("shared")
        both = total.groupBy("digest", "part").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
        total = total.drop("top", "n").join(both, ["digest", "part"]).drop("part")
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    return every.join(total, ["digest", "batch"]).select(
        "doc_id",
        F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "batch",
    )


def byte_checked(old: DataFrame, old_rows: DataFrame, new: DataFrame, new_rows: DataFrame, positives: DataFrame) -> DataFrame:
    """The positives whose whole normalised texts equal the snapshot's, byte by byte: (digest).

    One row stands for each digest on either side, so a hot digest is one comparison and one text.
    """

    def bucket(rows: DataFrame, docs: DataFrame) -> DataFrame:
        pick = rows.join(positives, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("pick"))
        text = docs.select("doc_id", lower_ascii(F.col("text")).alias("text"))
        return pick.join(text, F.col("pick").eqNullSafe(F.col("doc_id"))).where(F.sha2("text", 256) == F.col("digest")).select("digest", "text")

    a, b = bucket(old_rows, old), bucket(new_rows, new).withColumnRenamed("text", "other")
    return a.join(b, "digest").where(F.col("text").cast("binary") == F.col("other").cast("binary")).select("digest").distinct()


def split_by_arrival(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An older half (the snapshot) and a newer half (the incoming batch) by doc_id, by a hash of it where it is no whole number; a null id is new."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        old = F.coalesce((F.xxhash64("doc_id") < 0) & F.col("doc_id").isNotNull(), F.lit(False))
        return docs.where(old), docs.where(~old)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return docs.where(old), docs.where(~old)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old, new = split_by_arrival(docs)
    return exact_dedup(spark, new, [old]).drop("batch")

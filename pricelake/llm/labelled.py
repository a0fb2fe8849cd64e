"""Labelled rows for fitting, never of held-out ids: all of them, or a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is hashed as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def known(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label) of the ids that have a label and are not held out; of repeated labels of an id the greatest counts."""
    told = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
    return told.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows_per_class: int) -> DataFrame:
    """(text, label) of at most ``rows_per_class`` rows of each class, the least by a hash of the id.

    The bound makes the ids small enough to broadcast, so texts stay where they are. Rows without a label
    or a text are left out; of repeated labels of an id the greatest counts.
    """
    told = known(labels, label, modulus, remainder)
    order = F.xxhash64("doc_id", F.lit(label))
    pick = [told.where(F.col("label") == c).orderBy(order, "doc_id").limit(rows_per_class) for c in (0, 1)]
    ids = pick[0].union(pick[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").select("doc_id", "text", "label")

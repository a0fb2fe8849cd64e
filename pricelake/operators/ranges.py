"""Windows over keys of very many rows: ordered ranges, with the state carried over a range's end.

Rows are dealt over ranges of (keys, order) and written, so a long key lies in several ranges that follow one
another, and a task sees one range of it. What a row needs of the rows before its range is carried: of each
range the only key that can have begun before is its first, so at most as many rows are carried as there are
ranges, and the join with them is a broadcast of that size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def fresh(name: str) -> str:
    """A name that no table written before has, since plans not yet run may still read those."""
    return f"{name}-{uuid.uuid4().hex}"


def ranged(rows: DataFrame, keys: list[str], order: list[str], keep: Keep, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``range_``, written by ``keep``; about as many ranges as given, else as shuffles have partitions. Rows of equal keys and order share a range."""
    by = [*keys, *order]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    return keep(dealt.withColumn("range_", F.spark_partition_id()), fresh("ranges"))


def _carried(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """(range_, keys, carry_): the last ``value`` before the range of each key that lies in several ranges."""
    at = F.struct(*order)
    # A key goes on into a later range only as the last one of its own, so no more keys than ranges are grouped.
    last = rows.groupBy("range_").agg(F.max(F.struct(*keys)).alias("k_")).select("k_").distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_.{k}"))
    open_ = rows.join(F.broadcast(last), same, "left_semi")
    ends = open_.groupBy("range_", *keys).agg(F.max_by(value, F.when(value.isNotNull(), at)).alias("end_"))
    earlier = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("carry_", F.last("end_", ignorenulls=True).over(earlier))
    return ends.where("carry_ is not null").select("range_", *keys, "carry_")


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    named = carried.select(F.col("range_").alias("r_"), *[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], "carry_")
    same = F.col("range_") == F.col("r_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"k{i}_"))
    return rows.join(F.broadcast(named), same, "left").drop("r_", *[f"k{i}_" for i in range(len(keys))])


def lag_over(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the ``value`` (a struct, never null) of the row before, null for a key's first row."""
    w = W.partitionBy("range_", *keys).orderBy(*order)
    out = _joined(rows, _carried(rows, keys, order, value), keys)
    return out.withColumn(name, F.coalesce(F.lag(value).over(w), F.col("carry_"))).drop("carry_")


def last_over(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` (a struct) that is not null, up to the row itself."""
    w = W.partitionBy("range_", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _joined(rows, _carried(rows, keys, order, value), keys)
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("carry_"))).drop("carry_")

"""Price history: step functions of change-only snapshots (product_id, captured_at, price, ...)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import group_key, hours_before, with_store
from .ranges import Keep, last_over, ranged


def price_history_view(snapshots: DataFrame, listings: DataFrame, stores: DataFrame, zone: str = "Pacific/Auckland") -> DataFrame:
    own = with_store(listings.select("product_id", "store_id", "item_id", "raw_name"), stores, active=False)
    return snapshots.join(own, "product_id").select(
        "item_id", "chain", "store_name", "product_id", F.col("raw_name").alias("product"), F.from_utc_timestamp("captured_at", zone).alias("captured_at"), "price", F.col("non_special_price").alias("was_price"),
        F.col("is_on_special").alias("on_special"), "unit_price",
    )


def group_price_history(snapshots: DataFrame, listings: DataFrame, stores: DataFrame, product_id: str | None = None, now: datetime | None = None, days: int = 0) -> DataFrame:
    """A row a group and listing with its points by time: of the group of one listing, or of all groups.

    Retired listings count; listings without a point in the window have no row.
    """
    own = with_store(listings.withColumn("group_id", group_key()), stores, active=False).select("group_id", "product_id", "store_id", "store_name")
    if product_id is not None:
        own = own.join(own.where(F.col("product_id") == product_id).select("group_id"), "group_id", "left_semi")
    points = snapshots.where(F.col("captured_at") >= hours_before(now, 24 * days)) if days > 0 else snapshots
    return own.join(points, "product_id").groupBy("group_id", "product_id", "store_id", "store_name").agg(F.array_sort(F.collect_list(F.struct("captured_at", "price"))).alias("points"))


def price_intervals(snapshots: DataFrame) -> DataFrame:
    """Each price with the time until which it held; null is still."""
    w = W.partitionBy("product_id").orderBy("captured_at")
    return snapshots.withColumn("valid_until", F.lead("captured_at").over(w))


def price_as_of(queries: DataFrame, snapshots: DataFrame, keep: Keep | None = None, ranges: int | None = None) -> DataFrame:
    """For each query (product_id, at, ...) the last price at or before its time: a backward as-of join by one sorted pass.

    Queries and snapshots share one shuffle on the listing; no pair of a query and a snapshot is made. With
    ``keep``, which writes a table, a listing's history is cut into ranges of time, so that a listing with very
    many rows is several tasks.
    """
    q = queries.withColumns({"kind_": F.lit(1), "state_": F.lit(None).cast("struct<price: decimal(10,2), since: timestamp>")})
    s = snapshots.select("product_id", F.col("captured_at").alias("at"), F.lit(0).alias("kind_"), F.struct(F.col("price").cast("decimal(10,2)").alias("price"), F.col("captured_at").alias("since")).alias("state_"))
    both = q.unionByName(s, allowMissingColumns=True)
    if keep is not None:
        order = ["at", "kind_"]
        both = last_over(ranged(both, ["product_id"], order, keep, ranges), ["product_id"], order, F.col("state_"), "found_")
        return both.where("kind_ = 1").select(*queries.columns, F.col("found_.price").alias("price"), F.col("found_.since").alias("since"))
    w = W.partitionBy("product_id").orderBy("at", "kind_").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("state_", F.last("state_", ignorenulls=True).over(w))
    return both.where("kind_ = 1").select(*queries.columns, F.col("state_.price").alias("price"), F.col("state_.since").alias("since"))


#: Snapshots that a task of ``promo_windows`` takes, about.
ROWS_A_TASK = 500_000


def promo_windows(snapshots: DataFrame, rows: int | None = None) -> DataFrame:
    """Observed periods of a promotion: runs of snapshots of one type, until the next snapshot of another.

    Where it is known about how many ``rows`` there are, the number of tasks follows it, so that none holds more of
    them as the table grows.
    """
    if rows is not None:
        snapshots = snapshots.repartition(max(snapshots.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), "product_id")
    w = W.partitionBy("product_id").orderBy("captured_at")
    new = F.when(F.col("promo_type").eqNullSafe(F.lag("promo_type").over(w)), 0).otherwise(1)
    rows = snapshots.withColumns({"new": new, "until": F.lead("captured_at").over(w)})
    rows = rows.withColumn("island", F.sum("new").over(w)).where("promo_type <> 'None'")
    return rows.groupBy("product_id", "island", "promo_type").agg(
        F.min("captured_at").alias("started"), F.max_by("until", "captured_at").alias("ended"), F.min("price").alias("lowest"), F.count("*").alias("n_snapshots")
    ).drop("island")


def history_trend(snapshots: DataFrame, listings: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """By group: the least and greatest price of the window, its points, and the latest price of each of its stores."""
    own = listings.select("product_id", "store_id", group_key().alias("group_id"))
    rows = snapshots.where("price is not null").where(F.col("captured_at") >= hours_before(now, 24 * days)).join(own, "product_id")
    latest = rows.groupBy("group_id", "store_id").agg(F.max_by("price", F.struct("captured_at", "product_id")).alias("latest"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("n"))
    return latest.groupBy("group_id").agg(
        F.min("lo").alias("min_price"), F.max("hi").alias("max_price"), F.sum("n").alias("n_points"), F.min("latest").alias("lowest_latest"), F.count("*").alias("n_stores")
    )

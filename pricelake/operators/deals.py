"""Specials and deals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import is_variable_weight
from .catalog import group_key, hours_before, with_store

DEAL_HOURS = 48
#: Deals worth showing: a share off with a least saving, or a saving alone.
LEAST_SHARE, LEAST_SAVING, PLAIN_SAVING, SHOWN = 0.3, 1.0, 5.0, 30
SAME_PRICE = 0.009


def saving() -> Column:
    return F.col("current_non_special_price") - F.col("current_price")


def current_specials(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Listings on special whose earlier price is known, with the saving and whole percents off."""
    rows = with_store(listings.where("is_on_special and current_non_special_price is not null"), stores, active=False)
    pct = F.round(F.lit(100.0).cast("decimal(6,1)") * saving() / F.nullif(F.col("current_non_special_price"), F.lit(0).cast("decimal(10,2)")), 0)
    return rows.select(
        "product_id", "chain", "store_name", F.col("raw_name").alias("product"), F.col("raw_brand").alias("brand"), F.col("current_price").alias("price"), F.col("current_non_special_price").alias("was_price"),
        F.round(saving(), 2).alias("saving"), pct.alias("pct_off"), "unit_price", F.col("unit_of_measure").alias("uom"), "item_id",
    )


def deals(listings: DataFrame, stores: DataFrame, now: datetime, chain: str | None = None, store_ids: list[str] | None = None) -> DataFrame:
    """Available priced specials of active stores seen in the last 48 hours; the earlier price may be unknown."""
    rows = listings.where("is_available and is_on_special and current_price is not null").where(F.col("last_seen_at") >= hours_before(now, DEAL_HOURS))
    out = with_store(rows, stores).withColumn("saving", saving())
    out = out.where(F.col("chain") == chain) if chain else out
    return out.where(F.col("store_id").isin(store_ids)) if store_ids else out


def deal_order() -> list[Column]:
    """Known savings first, the greatest first; ties by listing."""
    return [F.col("saving").isNull(), F.col("saving").desc_nulls_last(), F.col("product_id")]


def real_saving() -> Column:
    """The saving of a pack; what is sold by weight saves nothing a pack."""
    weighed = is_variable_weight(F.col("current_price"), F.col("unit_price"), F.col("unit_of_measure"))
    return F.when(weighed, F.lit(0.0)).otherwise(F.col("saving").cast("double"))


def share_off() -> Column:
    return (F.col("saving") / F.nullif(F.col("current_non_special_price"), F.lit(0).cast("decimal(10,2)"))).cast("double")


def ranked(found: DataFrame) -> DataFrame:
    return found.withColumns({"share_off": F.coalesce(share_off(), F.lit(0.0)), "real_saving": F.coalesce(real_saving(), F.lit(0.0))})


def rank_order(mode: str) -> list[Column]:
    """percent: by share off, then saving; saving: by the saving of a pack, then share off."""
    plain = F.col("saving").desc_nulls_last()
    if mode == "percent":
        return [F.col("share_off").desc(), plain, F.col("product_id")]
    return [F.col("real_saving").desc(), F.col("share_off").desc(), F.col("product_id")]


def worth_showing(mode: str) -> Column:
    if mode == "percent":
        return (F.col("share_off") >= LEAST_SHARE) & (F.col("saving") >= LEAST_SAVING)
    return F.col("real_saving") >= PLAIN_SAVING


def showcase_deals(found: DataFrame, mode: str, n: int = SHOWN) -> DataFrame:
    """The first ``n`` deals of a ranking that are worth showing."""
    return ranked(found).where(worth_showing(mode)).orderBy(*rank_order(mode)).limit(n)


def deal_price_status(found: DataFrame, listings: DataFrame) -> DataFrame:
    """For each deal: whether it has its group's lowest price, the gap to the dearest, and the cheapest store."""
    groups = listings.where("is_available and current_price is not null").groupBy(group_key().alias("group_id")).agg(
        F.min("current_price").alias("lowest"), F.max("current_price").alias("highest"), F.min_by("store_id", F.struct("current_price", "store_id")).alias("cheapest_store_id")
    )
    out = found.withColumn("group_id", group_key()).join(groups, "group_id")
    return out.withColumns({"is_lowest": F.col("current_price") <= F.col("lowest") + F.lit(SAME_PRICE), "top_gap": F.col("highest") - F.col("current_price")})


def top_of(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n).drop("rn")

"""Reports on promotions, matching, stores and crawls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import loyalty_program
from .catalog import hours_before, with_store

# The order of chains in reports.
CHAINS = ("Woolworths", "NewWorld", "PaknSave", "FreshChoice")
STALE_STORE_HOURS, STALE_LISTING_HOURS = 48, 36


def promo_report(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """By chain of active stores, and in total: listings by promotion, percent on any, the programme. Retired listings count."""
    kind = lambda k: F.count_if(F.col("promo_type") == k)
    out = with_store(listings, stores).rollup("chain").agg(
        F.count("*").alias("total"), kind("None").alias("none"), kind("Special").alias("special"), kind("MemberPrice").alias("member"), kind("Multibuy").alias("multibuy")
    )
    percent = F.when(F.col("total") > 0, F.bround((F.col("total") - F.col("none")) * F.lit(100).cast("decimal(10,0)") / F.col("total"), 0)).otherwise(F.lit(0))
    return out.select(F.coalesce("chain", F.lit("TOTAL")).alias("chain"), "total", "none", "special", "member", "multibuy", percent.cast("long").alias("promo_percent"), loyalty_program(F.col("chain")).alias("programme"))


def match_status_counts(listings: DataFrame, stores: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Listings of active stores by chain, scheme of the item's key (null where there is none) and a pending candidate."""
    pending = candidates.where("status = 'Pending'").select("product_id").distinct().withColumn("has_pending", F.lit(True))
    keys = items.select("item_id", F.substring_index("match_key", ":", 1).alias("scheme"))
    rows = with_store(listings, stores).join(pending, "product_id", "left")
    linked = rows.where("item_id is not null").join(keys, "item_id", "left")
    rows = linked.select("chain", "scheme", "has_pending").unionByName(rows.where("item_id is null").select("chain", F.lit(None).cast("string").alias("scheme"), "has_pending"))
    return rows.groupBy("chain", "scheme", F.coalesce("has_pending", F.lit(False)).alias("has_pending")).agg(F.count("*").alias("n"))


def product_status_report(status: DataFrame) -> DataFrame:
    """Status counts folded to columns a chain, in total too; chains without listings have zeroes."""
    spark = status.sparkSession
    chains = spark.createDataFrame([(c,) for c in CHAINS], "chain string")
    scheme = F.col("scheme")
    known = {"foodstuffs": scheme == "foodstuffs", "woolworths": scheme == "woolworths", "freshchoice": scheme == "freshchoice"}
    other = scheme.isNotNull() & ~scheme.isin(*known)
    tell = known | {"manual": other, "pending": scheme.isNull() & F.col("has_pending"), "held": scheme.isNull() & ~F.col("has_pending")}
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in tell.items()] + [F.coalesce(F.sum("n"), F.lit(0)).alias("total")]
    rows = chains.join(status, "chain", "left")
    return rows.rollup("chain").agg(*sums).withColumn("chain", F.coalesce("chain", F.lit("Total")))


def coverage_percent(report: DataFrame) -> DataFrame:
    linked = F.col("foodstuffs") + F.col("woolworths") + F.col("freshchoice") + F.col("manual")
    return report.select("chain", linked.alias("linked"), "total", F.when(F.col("total") > 0, linked * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


def store_stats(stores: DataFrame, listings: DataFrame, runs: DataFrame, chain: str | None = None) -> DataFrame:
    """Active stores with their priced listings and the end of their last succeeded run."""
    s = stores.where("is_active")
    s = s.where(F.col("chain") == chain) if chain else s
    priced = listings.where("current_price is not null").groupBy("store_id").agg(F.count("*").alias("n_priced"))
    last = runs.where("status = 'Succeeded'").groupBy("store_id").agg(F.max("finished_at").alias("last_crawl"))
    out = s.join(priced, "store_id", "left").join(last, "store_id", "left")
    return out.select("store_id", "chain", F.col("name").alias("store_name"), F.coalesce("n_priced", F.lit(0)).alias("n_priced"), "last_crawl")


def crawl_run_report(runs: DataFrame, stores: DataFrame, zone: str = "Pacific/Auckland") -> DataFrame:
    local = lambda c: F.from_utc_timestamp(c, zone)
    rows = runs.join(stores.select("store_id", "chain", F.col("name").alias("store_name")), "store_id")
    return rows.select(
        "run_id", local("started_at").alias("started"), local("finished_at").alias("finished"), (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("seconds"),
        "store_name", "chain", "status", "products_found", "snapshots_written", "error_message",
    )


def staleness(stats: DataFrame, now: datetime) -> DataFrame:
    """Stores never crawled, or not in 48 hours."""
    old = F.col("last_crawl").isNull() | (F.col("last_crawl") < hours_before(now, STALE_STORE_HOURS))
    return stats.withColumn("stale", old)


def stale_listings(listings: DataFrame, now: datetime) -> DataFrame:
    return listings.where(F.col("last_seen_at") < hours_before(now, STALE_LISTING_HOURS))


def review_queue(candidates: DataFrame, listings: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    """Pending candidates with their listing, store and item."""
    rows = candidates.where("status = 'Pending'").drop("reviewed_at")
    own = with_store(listings.select("product_id", "store_id", "raw_name", "raw_brand", "raw_size", "current_price"), stores, active=False)
    return rows.join(own, "product_id").join(items.select("item_id", F.col("name").alias("item_name"), F.col("brand").alias("item_brand"), F.col("size").alias("item_size")), "item_id")


def queue_order() -> list[Column]:
    return [F.col("score").desc(), F.col("raw_name"), F.col("candidate_id")]


SEARCHED = ("raw_name", "raw_brand", "raw_size", "chain", "store_name", "item_name", "item_brand", "item_size", "reason")


def review_groups(queue: DataFrame, query: str | None = None) -> DataFrame:
    """The queue by listing: the top score, the number of candidates, their items best first; filtered by a text in any of nine fields."""
    if query and query.strip():
        text = query.strip().lower()
        hit = F.lit(False)
        for c in SEARCHED:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text)), F.lit(False))
        queue = queue.where(hit)
    one = F.struct((-F.col("score")).alias("order"), "item_id", "item_name", "score")
    return queue.groupBy("product_id").agg(F.max("score").alias("top_score"), F.count("*").alias("n_candidates"), F.min("raw_name").alias("raw_name"), F.array_sort(F.collect_list(one)).alias("candidates"))

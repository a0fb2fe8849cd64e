"""Search and grouping of listings: one group an item, or the listing alone where it has none.

Nested lists are bounded by the listings of an item. Null item ids never are a join or grouping key: the
key is the item or else the listing.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import comparable_unit_price
from .ranges import Keep, fresh


def with_store(listings: DataFrame, stores: DataFrame, active: bool = True) -> DataFrame:
    """Listings with chain, store_name and suburb; by default of active stores only."""
    s = stores.where("is_active") if active else stores
    return listings.join(s.select("store_id", "chain", F.col("name").alias("store_name"), "suburb"), "store_id")


def group_key() -> Column:
    return F.coalesce("item_id", "product_id")


def find_listings(listings: DataFrame, stores: DataFrame, q: str | None = None, store_ids: list[str] | None = None) -> DataFrame:
    """Available, priced listings of active stores, by a part of the name or brand and by store. ``%`` and ``_`` of q stay wildcards."""
    out = with_store(listings.where("is_available and current_price is not null"), stores)
    if q is not None and q.strip():
        like = f"%{q.strip()}%"
        out = out.where(F.col("raw_name").ilike(like) | F.coalesce(F.col("raw_brand").ilike(like), F.lit(False)))
    return out.where(F.col("store_id").isin(store_ids)) if store_ids else out


#: Letters of a posting's key.
GRAM = 3


def name_postings(listings: DataFrame) -> DataFrame:
    """(gram, text) for all runs of three letters in lower case of the different names and brands: write it sorted by gram, and a search reads its grams only.

    Shops sell the same names, so texts are indexed once, however many listings have them.
    """
    texts = listings.select(F.explode(F.array("raw_name", "raw_brand")).alias("text")).distinct()
    low = F.lower("text")
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substr(low, i, F.lit(GRAM)))
    return texts.where(F.length(low) >= GRAM).select(F.explode(F.array_distinct(grams)).alias("gram"), "text")


def write_postings(listings: DataFrame, keep: Keep) -> DataFrame:
    """The postings in ranges of grams, so that statistics of files and row groups prune all but a search's own."""
    return keep(name_postings(listings).repartitionByRange("gram", "text").sortWithinPartitions("gram", "text"), fresh("postings"))


def needle_grams(q: str) -> list[str]:
    """The runs of three letters that every match of ``%q%`` holds as they are.

    ``%`` and ``_`` part runs, a backslash makes the next letter plain. Runs with letters beyond ASCII are left to
    the exact filter, because their lower case may depend on what stands beside them.
    """
    parts = re.findall(r"(?s)\\.|.", q)
    plain = "".join("\x00" if x in ("%", "_") else x[-1] for x in parts).lower()
    runs = {plain[i : i + GRAM] for i in range(len(plain) - GRAM + 1)}
    return sorted(g for g in runs if g.isascii() and "\x00" not in g)


def search_listings(listings: DataFrame, stores: DataFrame, postings: DataFrame, q: str, store_ids: list[str] | None = None) -> DataFrame:
    """``find_listings`` by way of the postings: only listings whose name or brand holds all runs of the needle meet the exact filter.

    A needle without a run of three plain letters (short, or all wildcards) has nothing to look up and filters all listings.
    """
    grams = needle_grams(q.strip())
    if grams:
        held = postings.where(F.col("gram").isin(grams)).groupBy("text").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams))
        own, some = listings.columns, F.lit(False)
        for field in ("raw_name", "raw_brand"):
            # Listings without a text look up their id, so that nulls do not meet in one task; what that finds goes by the exact filter.
            found = held.select(F.col("text").alias(f"{field}_held_"))
            listings = listings.join(found, F.coalesce(field, "product_id") == F.col(f"{field}_held_"), "left")
            some = some | F.col(f"{field}_held_").isNotNull()
        listings = listings.where(some).select(*own)
    return find_listings(listings, stores, q, store_ids)


def in_category(listings: DataFrame, ids: DataFrame, items: DataFrame, links: DataFrame, store_categories: DataFrame) -> DataFrame:
    """Matched listings by their item's category, others by any of their own store categories mapped into ``ids`` (category_id)."""
    own_items = items.join(ids, "category_id", "left_semi").select("item_id")
    matched = listings.where("item_id is not null").join(own_items, "item_id", "left_semi")
    mapped = links.join(store_categories.join(ids, "category_id", "left_semi").select("store_category_id"), "store_category_id", "left_semi")
    return matched.unionByName(listings.where("item_id is null").join(mapped.select("product_id"), "product_id", "left_semi"))


def product_groups(listings: DataFrame) -> DataFrame:
    """One row a group: its listings by price (null last), whether there are several, and the figures that sorts need."""
    unit = comparable_unit_price(F.col("unit_price"), F.col("unit_of_measure"))
    rows = listings.select("*", group_key().alias("group_id"), F.bround(unit["price"], 2).alias("comparable_price"), unit["unit"].alias("comparable_unit"))
    member = F.struct(
        F.col("current_price").isNull().alias("unpriced"), F.col("current_price").alias("price"), "product_id", "store_id", F.col("raw_name").alias("name"), "comparable_price", "comparable_unit"
    )
    return rows.groupBy("group_id").agg(
        F.min_by("raw_name", F.struct(F.col("current_price").isNull(), "current_price", "product_id")).alias("name"),
        F.count("*").alias("n_listings"),
        (F.count("*") > 1).alias("comparable"),
        F.min("current_price").alias("min_price"),
        F.min("comparable_price").alias("min_unit_price"),
        F.max(F.col("current_non_special_price") - F.col("current_price")).alias("max_saving"),
        F.array_sort(F.collect_list(member)).alias("listings"),
    )


def store_span(listings: DataFrame, stores: DataFrame) -> DataFrame:
    """(item_id, n_stores): distinct active stores with an available priced listing."""
    return find_listings(listings, stores).where("item_id is not null").groupBy("item_id").agg(F.countDistinct("store_id").alias("n_stores"))


def spanning(groups: DataFrame, span: DataFrame) -> DataFrame:
    """Groups whose ``comparable`` says that the item is in several stores, for use under a store filter."""
    out = groups.join(span.withColumnRenamed("item_id", "group_id"), "group_id", "left")
    return out.withColumn("comparable", F.coalesce(F.col("n_stores") > 1, F.lit(False))).drop("n_stores")


def sort_keys(sort: str | None) -> list[Column]:
    """The order of groups: unitPriceAsc (also where unknown), priceAsc, nameAsc or discountDesc; ties by name, then group.

    Unit prices of kilograms, litres and pieces are compared as they are, and a discount counts whether or
    not the listing is on special: both are how the catalogue has always sorted.
    """
    name = [F.lower("name"), F.col("group_id")]
    if sort == "priceAsc":
        return [F.col("min_price").asc_nulls_last(), *name]
    if sort == "nameAsc":
        return name
    if sort == "discountDesc":
        return [F.col("max_saving").desc_nulls_last(), *name]
    return [F.coalesce("min_unit_price", "min_price").asc_nulls_last(), *name]


def placed(df: DataFrame, order: list[Column], keep) -> DataFrame:
    """``df`` with ``place``, its row's number from 1 in that order over the whole table.

    Rows are dealt over ranges of the order and sorted there; a range starts after the rows of those before it,
    so no task sees all rows. ``keep(df, name)`` writes the ranges, for they must not be dealt anew.
    """
    ranges = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("range_", F.shiftright("at_", 33))
    before = ranges.groupBy("range_").agg(F.count("*").alias("n")).withColumn("before_", F.sum("n").over(W.orderBy("range_")) - F.col("n"))
    place = F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(before.drop("n")), "range_").withColumn("place", place).drop("range_", "at_", "before_")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, its figures): size within 1 to 100, numbers from 1. Only the rows up to the page's end are gathered."""
    size, number = max(1, min(100, size)), max(1, number)
    total = df.agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    figures = total.select("total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_more"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), figures


class PageIndex:
    """Pages of one order over a table, each read from the ranges that hold it.

    ``write(df, name, by)`` writes a table in folders of the columns ``by`` and reads it back. Rows lie in a folder for each
    range of the order; what the driver holds is one number a range, the rows before it. So page n costs what
    page 1 does: the folders of one range, or of a few where ranges are smaller than a page.
    """

    def __init__(self, df: DataFrame, order: list[Column], write, ranges: int | None = None) -> None:
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        at = F.monotonically_increasing_id()
        rows = dealt.sortWithinPartitions(*order).select("*", F.shiftright(at, 33).cast("int").alias("range_"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at_"))
        self.rows, self.columns = write(rows, fresh("pages"), ["range_"]), df.columns
        sizes = self.rows.groupBy("range_").count().orderBy("range_").collect()
        self.starts, self.total = [], 0
        for r in sizes:
            self.starts.append((r["range_"], self.total, self.total + r["count"]))
            self.total += r["count"]

    def figures(self, number: int = 1, size: int = 20) -> tuple[int, int, bool]:
        """(total, total_pages, has_more)."""
        size, number = max(1, min(100, size)), max(1, number)
        pages = -(-self.total // size)
        return self.total, pages, number < pages

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """The rows of a page with their ``place`` from 1: size within 1 to 100, numbers from 1, none beyond the last page."""
        size, number = max(1, min(100, size)), max(1, number)
        low, high = (number - 1) * size, number * size
        held = [(r, a) for r, a, b in self.starts if a < high and b > low]
        before = F.coalesce(*[F.when(F.col("range_") == r, F.lit(a)) for r, a in held]) if held else F.lit(0)
        out = self.rows.where(F.col("range_").isin([r for r, _ in held]) if held else F.lit(False))
        out = out.withColumn("place", (before + F.col("at_") + 1).cast("long"))
        return out.where((F.col("place") > low) & (F.col("place") <= high)).orderBy("place").select(*[F.col(f"`{c}`") for c in self.columns], "place")


def group_for(listings: DataFrame, product_id: str) -> DataFrame:
    """The available, priced listings of the group that the listing belongs to."""
    keyed = listings.withColumn("group_id", group_key())
    wanted = keyed.where(F.col("product_id") == product_id).select("group_id")
    return keyed.where("is_available and current_price is not null").join(wanted, "group_id", "left_semi")


PROMO = {"special": "is_on_special", "member": "promo_type = 'MemberPrice'", "multibuy": "multibuy_total is not null"}


def filter_promo(listings: DataFrame, mode: str) -> DataFrame:
    """Listings of a promotion; filtered before grouping, so groups with none left vanish."""
    return listings.where(PROMO[mode])


def best_listing_per_group(listings: DataFrame) -> DataFrame:
    """The listing of each group with the least unit price, or else price; null last."""
    unit = comparable_unit_price(F.col("unit_price"), F.col("unit_of_measure"))["price"]
    rows = listings.withColumns({"group_id": group_key(), "rank_price": F.coalesce(unit.cast("double"), F.col("current_price").cast("double"))})
    w = W.partitionBy("group_id").orderBy(F.col("rank_price").asc_nulls_last(), "product_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def price_gap(listings: DataFrame) -> DataFrame:
    """(group_id, n_priced, min_price, max_price, gap, status) over the priced listings of each group."""
    out = listings.groupBy(group_key().alias("group_id")).agg(F.count("current_price").alias("n_priced"), F.min("current_price").alias("min_price"), F.max("current_price").alias("max_price"))
    gap = F.col("max_price") - F.col("min_price")
    status = F.when(F.col("n_priced") == 0, "no data").when(F.col("n_priced") == 1, "single").when(gap <= 0.009, "same").otherwise("gap")
    return out.select("*", gap.alias("gap"), status.alias("status"))


def product_compare(items: DataFrame, listings: DataFrame, stores: DataFrame, zone: str = "Pacific/Auckland") -> DataFrame:
    """A row for each item and listing with its store; inactive stores stay in."""
    rows = with_store(listings.where("item_id is not null"), stores, active=False)
    own = items.select("item_id", F.col("name").alias("product"), "brand", "size", "category")
    return rows.join(own, "item_id").select(
        "item_id", "product", "brand", "size", "category", "chain", "store_name", "suburb", "product_id", "raw_name", F.col("current_price").alias("price"), F.col("is_on_special").alias("on_special"),
        F.col("current_non_special_price").alias("was_price"), "unit_price", F.col("unit_of_measure").alias("uom"), F.from_utc_timestamp("last_seen_at", zone).alias("last_seen"),
    )


def cheapest_by_product(items: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """The cheapest listing of each item (unpriced ones last), with the number of listings and the spread to the dearest."""
    rows = product_compare(items, listings, stores)
    of = W.partitionBy("item_id")
    first = of.orderBy(F.col("price").asc_nulls_last(), "store_name", "product_id")
    rows = rows.withColumns({"rn": F.row_number().over(first), "store_count": F.count("*").over(of), "max_price": F.max("price").over(of)}).where("rn = 1")
    return rows.select("item_id", "product", "brand", "size", "category", F.col("price").alias("cheapest_price"), F.col("store_name").alias("cheapest_store"), "chain", "store_count", "max_price", F.round(F.col("max_price") - F.col("price"), 2).alias("spread"))


def branch_prices(items: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    rows = product_compare(items, listings, stores)
    out = rows.groupBy("item_id", "product", "chain").agg(F.count("*").alias("branches"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return out.withColumn("spread", F.round(F.col("max_price") - F.col("min_price"), 2))


def branch_price_variation(items: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Items that branches of a chain price differently."""
    return branch_prices(items, listings, stores).where("branches > 1 and min_price <> max_price")


def branch_variation_rate(items: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """By chain: items at two branches or more, the share of them whose prices differ, the mean and greatest gap."""
    several = branch_prices(items, listings, stores).where("branches > 1")
    differ = F.col("min_price") != F.col("max_price")
    return several.groupBy("chain").agg(
        F.count("*").alias("products"), F.count_if(differ).alias("differing"), (F.count_if(differ) * 100.0 / F.count("*")).alias("percent"),
        F.avg(F.when(differ, F.col("spread").cast("double"))).alias("avg_gap"), F.max("spread").alias("max_gap"),
    )


def hours_before(now: datetime, hours: int) -> Column:
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")

"""One category tree for all chains, and its counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import in_foodstuffs
from ..functions.text import slugify
from ..sources.tables import scratch_keep

LEVELS = ("Department", "Aisle", "Shelf")
# Departments of other chains by slug, and the shared department that each stands for.
DEPARTMENT_ALIASES = {
    "meat-poultry": "meat-poultry-seafood",
    "fish-seafood": "meat-poultry-seafood",
    "fruit-veg": "fruit-vegetables",
    "fridge-deli": "fridge-deli-eggs",
    "meat": "meat-poultry-seafood",
    "seafood": "meat-poultry-seafood",
    "dairy-eggs": "fridge-deli-eggs",
}


def category_paths(store_categories: DataFrame) -> DataFrame:
    """Store categories with the path of slugs from their department down: two joins for three levels."""
    node = store_categories.select("store_category_id", "parent_id", slugify(F.col("name")).alias("s0"))
    up = node.select(F.col("store_category_id").alias("p1"), F.col("parent_id").alias("p2"), F.col("s0").alias("s1"))
    top = node.select(F.col("store_category_id").alias("p2"), F.col("s0").alias("s2"))
    rows = node.withColumnRenamed("parent_id", "p1").join(up, "p1", "left").join(top, "p2", "left")
    return store_categories.join(rows.select("store_category_id", F.concat_ws("/", "s2", "s1", "s0").alias("path"), F.concat_ws("/", "s2", "s1").alias("parent_path")), "store_category_id")


def build_category_tree(store_categories: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Nodes (category_id = path, kind, name, slug, path, parent_id, is_archived) of the Foodstuffs shelves; existing ones stay as they are.

    ``store_categories`` carries the chain of its store. Of several names with one path the first by store and id counts.
    """
    rows = category_paths(store_categories.where(in_foodstuffs(F.col("chain"))))
    first = rows.groupBy("path").agg(F.min_by(F.struct("kind", "name", "parent_path"), F.struct("store_id", "store_category_id")).alias("n"))
    new = first.select(
        F.col("path").alias("category_id"), "n.kind", "n.name", F.substring_index("path", "/", -1).alias("slug"), "path", F.nullif(F.col("n.parent_path"), F.lit("")).alias("parent_id"), F.lit(False).alias("is_archived")
    )
    if existing is None:
        return new
    ids = existing.select(F.col("path").alias("parent_id"), F.col("category_id").alias("known_parent"))
    new = new.join(existing.select("path"), "path", "left_anti").join(ids, "parent_id", "left").withColumn("parent_id", F.coalesce("known_parent", "parent_id"))
    return existing.unionByName(new.select(*existing.columns))


def map_store_categories(store_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Store categories with category_id: Foodstuffs by path, others where unmapped by a (kind, slug) that one node has, or else by alias."""
    rows = category_paths(store_categories).withColumn("slug_", slugify(F.col("name")))
    by_path = categories.select("path", F.col("category_id").alias("own_id"))
    single = categories.groupBy("kind", F.col("slug").alias("slug_")).agg(F.count("*").alias("n"), F.min("category_id").alias("slug_id")).where("n = 1").drop("n")
    alias = store_categories.sparkSession.createDataFrame(list(DEPARTMENT_ALIASES.items()), "slug_ string, path string").join(categories.select("path", F.col("category_id").alias("alias_id")), "path").drop("path")
    rows = rows.join(by_path, "path", "left").join(single, ["kind", "slug_"], "left").join(alias, "slug_", "left")
    mapped = F.when(in_foodstuffs(F.col("chain")), F.col("own_id")).otherwise(F.coalesce("category_id", "slug_id", "alias_id"))
    return rows.withColumn("category_id", mapped).select(*store_categories.columns)


def assign_item_categories(items: DataFrame, listings: DataFrame, links: DataFrame, store_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with the finest mapped live category of their listings, Foodstuffs ones first; without one they stay as they are."""
    live = categories.where("not is_archived").select("category_id", F.col("name").alias("new_name"))
    mapped = store_categories.where("category_id is not null").select("store_category_id", "kind", F.col("category_id")).join(live, "category_id")
    rank = F.when(F.col("kind") == "Shelf", 0).when(F.col("kind") == "Aisle", 1).otherwise(2)
    rows = listings.where("item_id is not null").select("item_id", "product_id", "chain").join(links, "product_id").join(mapped, "store_category_id")
    best = rows.groupBy("item_id").agg(F.min_by(F.struct("category_id", "new_name"), F.struct((~in_foodstuffs(F.col("chain"))).cast("int"), rank, "product_id", "store_category_id")).alias("best"))
    out = items.join(best, "item_id", "left")
    return out.withColumns({"category_id": F.coalesce("best.category_id", "category_id"), "category": F.coalesce("best.new_name", "category")}).select(*items.columns)


def category_map_summary(categories: DataFrame, store_categories: DataFrame, items: DataFrame) -> DataFrame:
    """(measure, n): nodes, mapped store categories and categorised items."""
    n = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count("*").alias("n"))
    return n(categories, "nodes").union(n(store_categories.where("category_id is not null"), "mapped")).union(n(items.where("category_id is not null"), "categorised"))


def closure(categories: DataFrame, live_only: bool = True, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(ancestor_id, category_id) of nodes of a tree of any depth, each its own ancestor too.

    Pairs double in reach until none is new, so a tree of depth d takes log2(d) joins; a cycle of parents ends
    as well. ``keep`` writes the pairs of each round, by default to the scratch folder, so no round plans or runs
    those before it again. By default archived nodes are no nodes, so a branch below one is cut off.
    """
    keep = keep or scratch_keep(categories.sparkSession)
    nodes = (categories.where("not is_archived") if live_only else categories).select("category_id", "parent_id")
    own = nodes.select(F.col("category_id").alias("ancestor_id"), "category_id")
    up = nodes.select(F.col("parent_id").alias("ancestor_id"), "category_id").where("ancestor_id is not null")
    name = f"closure-{uuid.uuid4().hex}"
    pairs = keep(own.union(up.join(own.select("ancestor_id"), "ancestor_id", "left_semi")).distinct(), f"{name}-0")
    n, more, step = pairs.count(), -1, 0
    while n != more:
        below = pairs.select(F.col("ancestor_id").alias("mid"), F.col("category_id").alias("leaf"))
        longer = pairs.join(below, F.col("category_id") == F.col("mid")).select("ancestor_id", F.col("leaf").alias("category_id")).distinct()
        step += 1
        pairs = keep(longer, f"{name}-{step}")
        n, more = pairs.count(), n
    return pairs


def category_subtree(categories: DataFrame, root: str) -> DataFrame:
    """(category_id) of the live subtree; empty where the root is unknown or archived."""
    return closure(categories).where(F.col("ancestor_id") == root).select("category_id")


def category_counts(items: DataFrame, listings: DataFrame, links: DataFrame, store_categories: DataFrame, stores: DataFrame, store_ids: list[str] | None = None) -> DataFrame:
    """(category_id, n): items, plus unmatched priced available listings of active stores.

    Without a store filter every item of the category counts, merged and unavailable ones too; with one, an
    item needs a priced listing there.
    """
    own = items.where("category_id is not null").select("item_id", "category_id")
    rows = listings.where(F.col("store_id").isin(store_ids)) if store_ids else listings
    if store_ids:
        own = own.join(rows.where("current_price is not null and item_id is not null").select("item_id"), "item_id", "left_semi")
    open_ = rows.where("item_id is null and is_available and current_price is not null").join(stores.where("is_active").select("store_id"), "store_id", "left_semi").select("product_id")
    mapped = links.join(open_, "product_id", "left_semi").join(store_categories.where("category_id is not null").select("store_category_id", "category_id"), "store_category_id")
    loose = mapped.select("product_id", "category_id").distinct().select("category_id")
    return own.select("category_id").unionByName(loose).groupBy("category_id").agg(F.count("*").alias("n"))


def category_tree(categories: DataFrame, counts: DataFrame, kind: str | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Live nodes with their depth, their own count and that of their whole subtree.

    A node without a live parent is at depth 0. After the sum the tree is cut at depth 0 for Department, 1 for Aisle and
    2 otherwise, whatever the kinds of its nodes. Nodes that no root reaches, in a cycle, are left out.
    """
    pairs = closure(categories, keep=keep)
    live = categories.where("not is_archived")
    roots = live.select("category_id", "parent_id").join(live.select(F.col("category_id").alias("parent_id")), "parent_id", "left_anti").select(F.col("category_id").alias("ancestor_id"), F.lit(True).alias("root"))
    depth = pairs.join(roots, "ancestor_id", "left").groupBy("category_id").agg((F.count("*") - 1).alias("depth"), F.max("root").alias("root")).where("root").drop("root")
    depth = depth.where(F.col("depth") <= {"department": 0, "aisle": 1}.get((kind or "").lower(), 2))
    total = pairs.join(counts, "category_id").groupBy(F.col("ancestor_id").alias("category_id")).agg(F.sum("n").alias("total"))
    out = live.join(depth, "category_id").join(counts, "category_id", "left").join(total, "category_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("category_id", "parent_id", "kind", "name", "path", "depth", zero("n").alias("n"), zero("total").alias("total"))


def category_counts_view(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Every node with the number of its items."""
    n = items.where("category_id is not null").groupBy("category_id").agg(F.count("item_id").alias("products"))
    return categories.join(n, "category_id", "left").select("category_id", "kind", "path", "name", F.coalesce("products", F.lit(0)).alias("products"))

"""Change-only price history from repeated crawls.

Observations (store_id, sku, run_id, seq, price, ...) meet their runs (run_id, store_id, started_at,
complete, status). The state machine of a listing is a handful of windows on (store_id, sku), one shuffle:
what a listing showed before is ``lag``, a promotion that goes on is an island, and a listing that two
complete runs in a row did not return is retired. A failed run applies nothing. Within a run observations
go by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import Keep, fresh, lag_over, last_over, ranged

KEY = ["store_id", "sku"]
#: What makes a price row: it differs in one of these or is not written.
TUPLE = ["price", "promo_type", "was_price", "unit_price", "member_price", "multibuy_quantity", "multibuy_total"]
#: What retirement clears.
CLEARED = ["was_price", "member_price", "multibuy_quantity", "multibuy_total"]
MISSES = 2
SPECIAL = "Special"


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Applied runs with their place in the store's order and the complete runs up to (c_incl) and before (c_before) each."""
    order = W.partitionBy("store_id").orderBy("started_at", "run_id")
    done = F.col("complete").cast("int")
    return (
        runs.where("status is null or status <> 'Failed'")
        .withColumn("run_no", F.row_number().over(order))
        .withColumn("c_incl", F.sum(done).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long"))
        .withColumn("c_before", F.col("c_incl") - done)
    )


def _step(rows: DataFrame) -> DataFrame:
    """The window form: rows with run_no, seq, c_incl, c_before get was_price filled in and ``changed``."""
    w = W.partitionBy(*KEY).orderBy("run_no", "seq")
    on = F.col("promo_type") == SPECIAL
    rows = rows.withColumn("own_was", F.col("was_price")).withColumn("retired", F.coalesce(F.col("c_before") - F.lag("c_incl").over(w) >= MISSES, F.lit(False)))
    prev_on = F.coalesce(F.lag("promo_type").over(w) == SPECIAL, F.lit(False)) & ~F.col("retired")
    rows = rows.withColumns({"prev_on": prev_on, "prev_price": F.lag("price").over(w)})
    rows = rows.withColumn("island", F.sum(F.when(on & F.col("prev_on"), 0).otherwise(1)).over(w))
    seed = F.when(~on | F.col("own_was").isNotNull(), F.col("own_was")).when(~F.col("prev_on") & (F.col("prev_price") > F.col("price")), F.col("prev_price"))
    rows = rows.withColumn("seed", seed)
    within = W.partitionBy(*KEY, "island").orderBy("run_no", "seq")
    rows = rows.withColumn("was_price", F.when(on, F.last("seed", ignorenulls=True).over(within)).otherwise(F.col("own_was")))

    def before(c: str) -> Column:
        old = F.lag(c).over(w)
        if c == "promo_type":
            return F.when(F.col("retired"), F.lit("None")).otherwise(old)
        return F.when(~F.col("retired"), old) if c in CLEARED else old

    same = F.struct(*TUPLE).eqNullSafe(F.struct(*[before(c).alias(c) for c in TUPLE]))
    return rows.withColumn("changed", (F.row_number().over(w) == 1) | ~same).drop("own_was", "prev_on", "prev_price", "island", "seed", "retired")


def _step_ranged(rows: DataFrame, keep: Keep, ranges: int | None) -> DataFrame:
    """``_step`` over ranges of a listing's observations, each a task of its own, with three things carried into a range.

    These are the fields that the row before showed; the last mark of a promotion, which is its start or a later
    row that gives a was price; and the was price that the row before came to.
    """
    order = ["run_no", "seq"]
    rows = ranged(rows.withColumn("own_was", F.col("was_price")), KEY, order, keep, ranges)
    shown = [c for c in TUPLE if c != "was_price"]
    rows = lag_over(rows, KEY, order, F.struct(*shown, "c_incl"), "prev_")
    on = F.col("promo_type") == SPECIAL
    rows = rows.withColumn("retired", F.coalesce(F.col("c_before") - F.col("prev_.c_incl") >= MISSES, F.lit(False)))
    goes_on = on & F.coalesce(F.col("prev_.promo_type") == SPECIAL, F.lit(False)) & ~F.col("retired")
    dearer = ~F.coalesce(goes_on, F.lit(False)) & (F.col("prev_.price") > F.col("price"))
    seed = F.when(~on | F.col("own_was").isNotNull(), F.col("own_was")).when(dearer, F.col("prev_.price"))
    rows = rows.withColumn("mark_", F.when(~F.coalesce(goes_on, F.lit(False)) | seed.isNotNull(), F.struct(seed.alias("was"))))
    rows = last_over(rows, KEY, order, F.col("mark_"), "found_").withColumn("was_price", F.when(on, F.col("found_.was")).otherwise(F.col("own_was")))
    rows = lag_over(keep(rows.drop("mark_", "found_"), fresh("was")), KEY, order, F.struct("was_price"), "prev_was_")

    def before(c: str) -> Column:
        old = F.col("prev_was_.was_price") if c == "was_price" else F.col(f"prev_.{c}")
        if c == "promo_type":
            return F.when(F.col("retired"), F.lit("None")).otherwise(old)
        return F.when(~F.col("retired"), old) if c in CLEARED else old

    same = F.struct(*TUPLE).eqNullSafe(F.struct(*[before(c).alias(c) for c in TUPLE]))
    return rows.withColumn("changed", F.col("prev_was_").isNull() | ~same).drop("own_was", "prev_", "prev_was_", "retired", "range_")


def reconstruct_was_price(obs: DataFrame, runs: DataFrame, keep: Keep | None = None, ranges: int | None = None) -> DataFrame:
    """Observations with run_no, captured_at, the reconstructed was_price, and whether their tuple changed.

    With ``keep``, which writes a table, a listing's observations are cut into ranges, so that one with very many is several tasks.
    """
    r = numbered_runs(runs).select("run_id", "run_no", "c_incl", "c_before", F.col("started_at").alias("captured_at"))
    rows = obs.join(r, "run_id")
    return _step(rows) if keep is None else _step_ranged(rows, keep, ranges)


def price_snapshots(obs: DataFrame, runs: DataFrame, keep: Keep | None = None, ranges: int | None = None) -> DataFrame:
    """One row for each change of a listing's price tuple, the first sighting included."""
    return reconstruct_was_price(obs, runs, keep, ranges).where("changed").select(*KEY, "run_id", "seq", "captured_at", *TUPLE, (F.col("promo_type") == SPECIAL).alias("is_on_special"), F.lit("NZD").alias("currency"))


def current_listings(obs: DataFrame, runs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The latest fields of each listing, first and last sighting and the time of its last snapshot."""
    state = reconstruct_was_price(obs, runs)
    last = F.max_by(F.struct(*TUPLE, *extra, "c_incl"), F.struct("run_no", "seq")).alias("last")
    out = state.groupBy(*KEY).agg(
        last, F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"), F.max(F.when(F.col("changed"), F.col("captured_at"))).alias("price_updated_at")
    )
    return out.select(*KEY, "last.*", "first_seen_at", "last_seen_at", "price_updated_at")


def availability(obs: DataFrame, runs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Current listings with misses, missing_since and is_available; a retired listing shows no promotion.

    Misses are a difference of running counts, so no listing meets every run.
    """
    numbered = numbered_runs(runs)
    total = numbered.groupBy("store_id").agg(F.max("c_incl").alias("c_total"))
    first_miss = numbered.where("complete").select("store_id", (F.col("c_incl") - 1).alias("c_incl"), F.col("started_at").alias("missing_since"))
    out = current_listings(obs, runs, extra).join(total, "store_id").join(first_miss, ["store_id", "c_incl"], "left")
    out = out.withColumn("misses", (F.col("c_total") - F.col("c_incl")).cast("int"))
    return retire(out.withColumn("is_available", F.col("misses") < MISSES)).drop("c_incl", "c_total")


def retire(listings: DataFrame) -> DataFrame:
    """Promotion fields of unavailable listings cleared; the price stays."""
    gone = ~F.col("is_available")
    out = listings.withColumn("promo_type", F.when(gone, F.lit("None")).otherwise(F.col("promo_type")))
    for c in CLEARED:
        out = out.withColumn(c, F.when(~gone, F.col(c)))
    return out


STATE = [*KEY, *TUPLE, "first_seen_at", "last_seen_at", "price_updated_at", "misses", "missing_since", "is_available"]
#: What an observation says besides its price; a listing shows that of its last one.
RAW = ["name", "brand", "size", "gtin", "url", "image_url", "unit_of_measure"]


def apply_runs(state: DataFrame, scraped: DataFrame, runs: DataFrame, extra: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Any new runs of any stores at once: (new state, snapshots, run rows), as a replay of all runs would give them.

    A listing's old state stands before its new rows as an observation that missed as many complete runs as it
    counts, so the windows of the replay go on from it. ``state`` holds at least the listings of the stores that have
    runs; ``extra`` names columns, such as those in RAW, that it carries along. Runs are later than those in the state.
    """
    numbered = numbered_runs(runs)
    r = numbered.select("run_id", "run_no", "c_incl", "c_before", F.col("started_at").alias("captured_at"))
    cols = [*KEY, *TUPLE, *extra]
    # An old misses counter is a number of complete runs before the first new one.
    old = state.select(
        *cols, F.lit(None).cast("string").alias("run_id"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("run_no"), (-F.col("misses")).cast("long").alias("c_incl"), F.lit(0).cast("long").alias("c_before"),
        F.lit(None).cast("timestamp").alias("captured_at"),
    )
    new = scraped.select(*cols, "run_id", F.col("seq").cast("long").alias("seq")).join(r, "run_id")
    rows = _step(old.unionByName(new)).where("run_no > 0")
    snaps = rows.where("changed").select(*KEY, "run_id", "seq", "captured_at", *TUPLE, (F.col("promo_type") == SPECIAL).alias("is_on_special"), F.lit("NZD").alias("currency"))
    seen = rows.groupBy(*KEY).agg(
        F.max_by(F.struct(*TUPLE, *extra, "c_incl"), F.struct("run_no", "seq")).alias("now"), F.min("captured_at").alias("first_now"), F.max("captured_at").alias("last_now"),
        F.max(F.when(F.col("changed"), F.col("captured_at"))).alias("moved_at"),
    )
    total = numbered.groupBy("store_id").agg(F.max("c_incl").alias("c_total"))
    missed = numbered.where("complete").select("store_id", (F.col("c_incl") - 1).alias("since"), F.col("started_at").alias("missed_at"))
    here = F.col("now").isNotNull()
    both = state.join(seen, KEY, "full_outer").withColumn("since", F.when(here, F.col("now.c_incl")).otherwise(0).cast("long"))
    both = both.join(total, "store_id", "left").join(missed, ["store_id", "since"], "left")
    misses = F.coalesce(F.col("c_total"), F.lit(0)) - F.when(here, F.col("now.c_incl")).otherwise(-F.col("misses"))
    out = both.select(
        *KEY,
        *[F.when(here, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in TUPLE],
        F.coalesce("first_seen_at", "first_now").alias("first_seen_at"),
        F.coalesce("last_now", "last_seen_at").alias("last_seen_at"),
        F.coalesce("moved_at", "price_updated_at").alias("price_updated_at"),
        misses.cast("int").alias("misses"),
        F.when(here, F.col("missed_at")).otherwise(F.coalesce("missing_since", "missed_at")).alias("missing_since"),
        (misses < MISSES).alias("is_available"),
        *[F.when(here, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in extra],
    )
    return retire(out), snaps, close_crawl_runs(scraped, snaps, runs)


def apply_crawl_run(state: DataFrame, scraped: DataFrame, run: DataFrame, extra: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of one store: ``apply_runs`` on that store's listings, the others as they are."""
    mine = run.select("store_id")
    new, snaps, closed = apply_runs(state.join(F.broadcast(mine), "store_id", "left_semi"), scraped, run, extra)
    return new.unionByName(state.join(F.broadcast(mine), "store_id", "left_anti").select(*new.columns)), snaps, closed


def category_nodes(scraped: DataFrame) -> DataFrame:
    """(store_id, kind, external_id, slug, name, parent_kind, parent_external_id, run_no, seq, at) of each path's nodes."""
    each = scraped.select("store_id", "run_no", "seq", "category_path", F.posexplode("category_path").alias("at", "n"))
    parent = F.get("category_path", F.col("at") - 1)
    return each.select("store_id", "n.kind", "n.external_id", "n.slug", "n.name", parent["kind"].alias("parent_kind"), parent["external_id"].alias("parent_external_id"), "run_no", "seq", "at")


def upsert_store_categories(scraped: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Nodes (store_id, kind, external_id): the first seen slug and name; a parent fills in only where there is none yet."""
    nodes = category_nodes(scraped)
    when = F.struct("run_no", "seq", "at")
    parent = F.when(F.col("parent_kind").isNotNull(), F.struct("parent_kind", "parent_external_id"))
    new = nodes.groupBy("store_id", "kind", "external_id").agg(
        F.min_by(F.struct("slug", "name"), when).alias("first"), F.min_by(parent, F.when(parent.isNotNull(), when)).alias("parent")
    )
    new = new.select("store_id", "kind", "external_id", "first.*", "parent.*")
    if existing is None:
        return new
    old = existing.select("store_id", "kind", "external_id", *[F.col(c).alias(f"old_{c}") for c in ("slug", "name", "parent_kind", "parent_external_id")])
    both = new.join(old, ["store_id", "kind", "external_id"], "full_outer")
    own = F.col("old_parent_kind").isNotNull()
    pick = lambda c: F.when(own, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("store_id", "kind", "external_id", F.coalesce("old_slug", "slug").alias("slug"), F.coalesce("old_name", "name").alias("name"), pick("parent_kind"), pick("parent_external_id"))


def product_category_links(scraped: DataFrame, runs: DataFrame) -> DataFrame:
    """Links (store_id, sku, kind, external_id) after all runs: a complete run replaces those of the listings it saw, a partial one adds.

    So a listing keeps the links of its last complete run that saw it and of all runs since.
    """
    r = numbered_runs(runs).select("run_id", F.col("run_no").alias("no"), "complete")
    rows = scraped.drop("run_no", "complete").join(r, "run_id")
    base = F.max(F.when(F.col("complete"), F.col("no"))).over(W.partitionBy(*KEY))
    kept = rows.withColumn("base", base).where("base is null or no >= base")
    return kept.select(*KEY, F.explode("category_path").alias("n")).select(*KEY, "n.kind", "n.external_id").distinct()


def merge_category_links(links: DataFrame, scraped: DataFrame, runs: DataFrame) -> DataFrame:
    """``links`` (store_id, sku, kind, external_id) after new runs, later than those that made them.

    What a complete run saw loses its old links, other listings that were seen gain some, the rest stays as it is.
    """
    done = scraped.select(*KEY, "run_id").join(numbered_runs(runs).where("complete").select("run_id"), "run_id", "left_semi").select(*KEY).distinct()
    kept = links.join(done, KEY, "left_anti").select(*KEY, "kind", "external_id")
    return kept.unionByName(product_category_links(scraped, runs)).distinct()


def merge_tags(tags: DataFrame, links: DataFrame, scraped: DataFrame, runs: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags with times, links) after new runs: a tag has its earliest label, whichever store's run comes first; a listing that was seen has the tags of its last run alone."""
    new_tags, new_links = sync_tags(scraped, runs, stores, times=True)
    key = ["chain", "source", "code"]
    every = tags.select(new_tags.columns).unionByName(new_tags).groupBy(*key).agg(F.min_by(F.struct("label", "labelled_at", "labelled_by"), F.struct("labelled_at", "labelled_by")).alias("first"))
    seen = scraped.select(*KEY, "run_id").join(numbered_runs(runs).select("run_id"), "run_id", "left_semi").select(*KEY).distinct()
    return every.select(*key, "first.*"), links.join(seen, KEY, "left_anti").select(*KEY, *key).unionByName(new_links.select(*KEY, *key))


def sync_tags(scraped: DataFrame, runs: DataFrame, stores: DataFrame, times: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tags, links): tags by (chain, source, code) with their first label; each listing's links are those of its last run.

    With ``times`` tags also tell when and by which run they were labelled, which ``merge_tags`` needs.
    """
    r = numbered_runs(runs).select("run_id", F.col("run_no").alias("no"), "started_at")
    rows = scraped.join(r, "run_id").join(stores.select("store_id", "chain"), "store_id")
    each = rows.select(*KEY, "chain", "no", "started_at", "run_id", "seq", F.explode("tags").alias("t")).select("*", "t.source", "t.code", "t.label")
    first = F.min(F.struct(F.col("started_at").alias("labelled_at"), F.col("run_id").alias("labelled_by"), "seq", "label")).alias("first")
    tags = each.groupBy("chain", "source", "code").agg(first).select("chain", "source", "code", "first.label", *(["first.labelled_at", "first.labelled_by"] if times else []))
    last = rows.groupBy(*KEY).agg(F.max("no").alias("no"))
    return tags, each.join(last, [*KEY, "no"]).select(*KEY, "chain", "source", "code").distinct()


def close_crawl_runs(scraped: DataFrame, snapshots: DataFrame | None, runs: DataFrame) -> DataFrame:
    """Runs with their finished_at, products_found (rows, duplicates included), snapshots_written, status and the error cut to 2000 characters."""
    found = scraped.groupBy("run_id").agg(F.count("*").alias("products_found"))
    runs = runs.drop("products_found", "snapshots_written")
    out = runs.join(found, "run_id", "left")
    if snapshots is not None:
        out = out.join(snapshots.groupBy("run_id").agg(F.count("*").alias("snapshots_written")), "run_id", "left")
    else:
        out = out.withColumn("snapshots_written", F.lit(0))
    gaps = F.array_join("gaps", " | ") if "gaps" in runs.columns else F.lit(None).cast("string")
    message = F.coalesce(F.col("error_message"), F.nullif(gaps, F.lit(""))) if "error_message" in runs.columns else F.nullif(gaps, F.lit(""))
    failed = F.coalesce(F.col("status") == "Failed", F.lit(False))
    return out.select(
        "run_id",
        "store_id",
        "started_at",
        (F.col("finished_at") if "finished_at" in runs.columns else F.lit(None)).cast("timestamp").alias("finished_at"),
        F.when(failed, 0).otherwise(F.coalesce("products_found", F.lit(0))).cast("int").alias("products_found"),
        F.when(failed, 0).otherwise(F.coalesce("snapshots_written", F.lit(0))).cast("int").alias("snapshots_written"),
        F.when(failed, F.lit("Failed")).when(F.col("complete"), F.lit("Succeeded")).otherwise(F.lit("Partial")).alias("status"),
        F.substring(message, 1, 2000).alias("error_message"),
    )

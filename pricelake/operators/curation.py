"""Batches of decisions made by people: reviews, links, merges, new items, category edits.

Each takes a batch as a DataFrame and gives the changed tables with one outcome a request.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..sources.tables import scratch_keep
from .categories import LEVELS, closure
from .matching import ITEM, Keep, resolve_merges


def apply_review_decisions(candidates: DataFrame, listings: DataFrame, items: DataFrame, decisions: DataFrame, now: datetime | None = None, keep: Keep | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, listings, outcomes) of decisions (candidate_id, approve) made ``now``: only pending ones change, others are conflicts.

    An approval links the listing to the item's survivor and deletes its other pending candidates. Of two
    approvals for one listing that with the lower id counts; of several decisions on one candidate an approval
    counts, or else one rejection, and the others are conflicts: each request has one outcome.
    """
    again = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.col("approve").desc())) > 1
    decisions = decisions.select("candidate_id", F.coalesce("approve", F.lit(False)).alias("approve")).withColumn("again", again)
    rows = decisions.join(candidates.select("candidate_id", "product_id", "item_id", "status"), "candidate_id", "left")
    pending = F.coalesce(F.col("status") == "Pending", F.lit(False)) & ~F.col("again")
    first = F.row_number().over(W.partitionBy("product_id", F.col("approve") & pending).orderBy("candidate_id")) == 1
    rows = rows.withColumn("outcome", F.when(F.col("status").isNull(), "unknown").when(~pending | (F.col("approve") & ~first), "conflict").when(F.col("approve"), "approved").otherwise("rejected"))
    done = rows.where("outcome in ('approved', 'rejected')").select("candidate_id", F.initcap("outcome").alias("new_status"))
    linked = rows.where("outcome = 'approved'").join(resolve_merges(items, keep), "item_id").select("product_id", F.col("live_id").alias("new_item"))
    out = candidates.join(done, "candidate_id", "left")
    if "reviewed_at" in candidates.columns:
        out = out.withColumn("reviewed_at", F.when(F.col("new_status").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("reviewed_at")))
    out = out.withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    gone = out.where("status = 'Pending'").join(linked, "product_id", "left_semi").select("candidate_id")
    out = out.join(gone, "candidate_id", "left_anti").select(*candidates.columns)
    after = listings.join(linked, "product_id", "left").withColumn("item_id", F.coalesce("new_item", "item_id")).select(*listings.columns)
    return out, after, rows.select("candidate_id", "outcome")


def apply_manual_links(listings: DataFrame, candidates: DataFrame, items: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listings, candidates, outcomes) of links (product_id, item_id or null to clear): the item must exist unmerged.

    Of several valid requests for one listing that with the lowest item counts (a clearing one first), the others
    are conflicts.
    """
    live = items.where("merged_into_id is null").select("item_id", F.lit(True).alias("live"))
    known = listings.select("product_id", F.lit(True).alias("known"))
    rows = links.join(live, "item_id", "left").join(known, "product_id", "left")
    ok = F.col("known").isNotNull() & (F.col("item_id").isNull() | F.col("live").isNotNull())
    first = F.row_number().over(W.partitionBy("product_id", ok).orderBy("item_id")) == 1
    rows = rows.withColumn("outcome", F.when(~ok, "rejected").when(~first, "conflict").when(F.col("item_id").isNull(), "cleared").otherwise("linked"))
    done = rows.where("outcome in ('cleared', 'linked')").select("product_id", F.col("item_id").alias("new_item"), F.lit(True).alias("hit"))
    after = listings.join(done, "product_id", "left").withColumn("item_id", F.when(F.col("hit"), F.col("new_item")).otherwise(F.col("item_id"))).select(*listings.columns)
    linked = done.where("new_item is not null").select("product_id")
    left = candidates.where("status <> 'Pending'").unionByName(candidates.where("status = 'Pending'").join(linked, "product_id", "left_anti"))
    return after, left, rows.select("product_id", "outcome")


def _cycles(edges: DataFrame, keep: Keep) -> DataFrame:
    """(source_id, nr) of the last request of each cycle of ``edges`` (source_id, to_id, nr), of which a source has one; no two share nr.

    Pointers double, each with the least item that it comes to and the last request on its way. Ways around a cycle are
    whole once a doubling lowers no least item: shorter ones, laid end to end, would come to the cycle's least one. So
    the rounds follow the longest way, not the number of edges. A source that is the least item its own way comes to
    lies on a cycle, and is the only such one of it.
    """
    name, n = f"cycles-{uuid.uuid4().hex}", edges.count()
    way = keep(edges.select("source_id", F.col("to_id").alias("end"), F.col("to_id").alias("low"), F.col("nr").alias("last")), f"{name}-0")
    for step in range(1, max(1, n).bit_length() + 1):
        nxt = way.select(F.col("source_id").alias("end"), F.col("end").alias("end2"), F.col("low").alias("low2"), F.col("last").alias("last2"))
        # Ways that have left the sources are done.
        longer = way.join(nxt, "end").select("source_id", F.col("end2").alias("end"), F.least("low", "low2").alias("low"), F.greatest("last", "last2").alias("last"), (F.col("low2") < F.col("low")).alias("lower"))
        way = keep(longer, f"{name}-{step}")
        left = way.agg(F.count("*").alias("n"), F.count_if("lower").alias("lower")).first()
        if not left["n"]:
            return edges.select("source_id", "nr").limit(0)
        if not left["lower"]:
            break
    return edges.join(way.where("source_id = low").select(F.col("last").alias("nr")), "nr", "left_semi").select("source_id", "nr")


def apply_item_merges(items: DataFrame, listings: DataFrame, candidates: DataFrame, pairs: DataFrame, keep: Keep | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, listings, candidates, outcomes) of merges (source_id, target_id) into the target's live survivor.

    Requests go by ``request_no`` where there is one, else by target. They follow one another: a to b and b to c in one
    batch lead a and b to c. Rejected: a merge with itself, an unknown item, a source merged elsewhere before
    (``conflict`` where by this batch), and the request that would close a cycle. The same merge again changes nothing.
    """
    keep = keep or scratch_keep(items.sparkSession)
    name = f"merge-{uuid.uuid4().hex}"
    live = keep(resolve_merges(items, keep), f"{name}-live")
    nr = F.struct(*[F.col(c) for c in ("request_no", "target_id", "source_id") if c in pairs.columns])
    rows = pairs.withColumn("nr", nr).join(live.select(F.col("item_id").alias("source_id"), F.col("live_id").alias("source_live")), "source_id", "left")
    rows = rows.join(live.select(F.col("item_id").alias("target_id"), F.col("live_id").alias("target_live")), "target_id", "left")
    merged = F.col("source_live") != F.col("source_id")
    outcome = (
        F.when(F.col("source_live").isNull() | F.col("target_live").isNull(), "unknown").when(F.col("source_id") == F.col("target_id"), "self").when(merged & (F.col("source_live") == F.col("target_live")), "unchanged")
        .when(merged, "merged elsewhere").when(F.col("target_live") == F.col("source_id"), "cycle")
    )
    rows = keep(rows.withColumn("outcome", outcome).withColumn("twin", F.row_number().over(W.partitionBy("source_id", "nr").orderBy("target_id"))), f"{name}-0")
    # The first request of each source that closes no cycle counts; each round takes out one request of a cycle.
    open_, shut, step = rows.where("outcome is null"), None, 0
    while True:
        left = open_ if shut is None else open_.join(shut, ["source_id", "nr"], "left_anti")
        first = left.groupBy("source_id").agg(F.min(F.struct("nr", "target_live")).alias("f"))
        edges = keep(first.select("source_id", F.col("f.target_live").alias("to_id"), F.col("f.nr").alias("nr")), f"{name}-edges{step}")
        found = keep(_cycles(edges, keep), f"{name}-cycles{step}")
        if not found.limit(1).count():
            break
        shut, step = found if shut is None else shut.union(found), step + 1
    taken = edges.select("source_id", F.col("nr").alias("taken"), F.col("to_id").alias("taken_to"))
    rows = rows.join(taken, "source_id", "left")
    closes = shut.withColumn("closes", F.lit(True)) if shut is not None else None
    rows = rows.join(closes, ["source_id", "nr"], "left") if closes is not None else rows.withColumn("closes", F.lit(None).cast("boolean"))
    own = F.when(F.col("closes"), "cycle").when((F.col("taken") == F.col("nr")) & (F.col("twin") == 1), "merged").when(F.col("taken_to") == F.col("target_live"), "unchanged").otherwise("conflict")
    rows = keep(rows.withColumn("outcome", F.coalesce("outcome", own)), f"{name}-outcomes")
    done = edges.select(F.col("source_id").alias("item_id"), "to_id")
    after = items.join(done, "item_id", "left").withColumn("merged_into_id", F.coalesce("to_id", "merged_into_id")).select(*items.columns)
    # What pointed at a source goes to the end of its chain.
    ends = resolve_merges(done.withColumnRenamed("to_id", "merged_into_id"), keep).where("item_id <> live_id").withColumnRenamed("live_id", "to_id")
    none = F.lit(None).cast("string").alias("to_id")
    # Rows without an item stay out of the join, so that nulls do not meet in one task.
    moved = lambda df: df.where("item_id is not null").join(ends, "item_id", "left").withColumn("item_id", F.coalesce("to_id", "item_id")).unionByName(df.where("item_id is null").select("*", none))
    # A pair that the survivor already has stays; of two moved ones the first by id.
    w = W.partitionBy("product_id", "item_id").orderBy(F.col("to_id").isNotNull(), "candidate_id")
    left = moved(candidates).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*candidates.columns)
    return after, moved(listings).select(*listings.columns), left, rows.select("source_id", "target_id", "outcome")


def create_manual_items(items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes) of requests (request_id, name, description, brand, size, category): a name is required.

    A request whose item exists already, from this batch or one before, makes none again: it is unchanged.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = requests.select("request_id", *[text(c).alias(c) for c in ("name", "description", "brand", "size", "category")])
    rows = rows.withColumn("item_id", F.substring(F.sha2(F.concat(F.lit("manual:"), "request_id"), 256), 1, 32))
    none = F.lit(None).cast("string")
    named = F.col("name").isNotNull()
    first = F.row_number().over(W.partitionBy("request_id", named).orderBy("name", "description", "brand", "size", "category")) == 1
    rows = rows.join(items.select("item_id", F.lit(True).alias("known")), "item_id", "left")
    rows = rows.withColumn("outcome", F.when(~named, "rejected").when(F.col("known").isNotNull() | ~first, "unchanged").otherwise("created"))
    new = rows.where("outcome = 'created'").select(
        "item_id", F.concat(F.lit("manual:"), "item_id").alias("match_key"), "name", F.coalesce("description", "name").alias("description"), "brand", "size", none.alias("unit_of_measure"),
        F.coalesce("category", F.lit("Uncategorised")).alias("category"), none.alias("category_id"), none.alias("gtin"), none.alias("merged_into_id"),
    )
    return items.unionByName(new.select(*ITEM)), rows.select("request_id", "outcome")


def apply_category_edits(categories: DataFrame, edits: DataFrame, keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """(categories, outcomes) of edits (edit_id, op: create | rename | archive, category_id, parent_id, kind, name).

    Nodes are made level by level: the parent of one may be made by the same batch, under the id that is its path.
    Renames and archives are judged against the tree before the batch. A new node's slug and path follow from its
    name; its kind must be known, its parent live and its path new. A rename changes the name only. An archive takes
    all descendants along, also those below nodes that were archived before; ``flipped`` of an outcome is the number
    of nodes that it archives, none where all of them were.
    """
    keep = keep or scratch_keep(categories.sparkSession)
    name = f"edits-{uuid.uuid4().hex}"
    live = categories.where("not is_archived")
    kinds = F.create_map(*[F.lit(x) for k in LEVELS for x in (k.lower(), k)])
    todo = keep(edits.where("op = 'create'").withColumns({"slug": slugify(F.col("name")), "kind": F.element_at(kinds, F.lower("kind"))}), f"{name}-0")
    parents, taken, new, step = live.select(F.col("category_id").alias("parent_id"), F.col("path").alias("parent_path")), categories.select("path"), None, 0
    while True:
        # Edits whose parent is there; the others wait for the next level.
        ready = todo.join(parents, "parent_id", "left").where("parent_id is null or parent_path is not null").withColumn("path", F.concat_ws("/", "parent_path", "slug"))
        ready = ready.join(taken.distinct().withColumn("taken", F.lit(True)), "path", "left")
        bad = F.col("kind").isNull() | F.coalesce(F.col("slug") == "", F.lit(True)) | F.col("taken").isNotNull()
        first = F.row_number().over(W.partitionBy("path", bad).orderBy("edit_id")) == 1
        ready = keep(ready.withColumn("outcome", F.when(bad | ~first, "rejected").otherwise("created")), f"{name}-level{step}")
        new = ready if new is None else new.unionByName(ready)
        made = ready.where("outcome = 'created'").select(F.col("path").alias("parent_id"), F.col("path").alias("parent_path"))
        todo = keep(todo.join(ready.select("edit_id"), "edit_id", "left_anti"), f"{name}-todo{step}")
        if not todo.join(made, "parent_id", "left_semi").limit(1).count():
            break
        parents, taken, step = made, taken.union(made.select("parent_path")), step + 1
    null = F.lit(None).cast("string")
    new = new.unionByName(todo.withColumns({"path": null, "parent_path": null, "taken": F.lit(None).cast("boolean"), "outcome": F.lit("rejected")}))
    known = categories.select("category_id", F.lit(True).alias("known"))
    named = edits.where("op = 'rename'").join(known, "category_id", "left")
    named = named.withColumn("outcome", F.when(F.col("known").isNull() | (F.coalesce(F.trim("name"), F.lit("")) == ""), "rejected").otherwise("renamed"))
    shut = edits.where("op = 'archive'").join(known, "category_id", "left").withColumn("outcome", F.when(F.col("known").isNull(), "rejected").otherwise("archived"))
    roots = shut.where("outcome = 'archived'").select("edit_id", F.col("category_id").alias("ancestor_id"))
    below = closure(categories, live_only=False, keep=keep).join(roots, "ancestor_id").join(live.select("category_id"), "category_id", "left_semi")
    flipped = below.groupBy("edit_id").agg(F.count("*").alias("flipped"))
    gone = below.select("category_id", F.lit(True).alias("gone")).distinct()
    names = named.where("outcome = 'renamed'").groupBy("category_id").agg(F.max_by(F.trim("name"), "edit_id").alias("new_name"))
    out = categories.join(gone, "category_id", "left").join(names, "category_id", "left")
    out = out.withColumns({"is_archived": F.col("is_archived") | F.col("gone").isNotNull(), "name": F.coalesce("new_name", "name")}).select(*categories.columns)
    added = new.where("outcome = 'created'").select(F.col("path").alias("category_id"), "kind", F.trim("name").alias("name"), "slug", "path", "parent_id", F.lit(False).alias("is_archived"))
    outcomes = new.select("edit_id", "outcome").union(named.select("edit_id", "outcome")).union(shut.select("edit_id", "outcome"))
    outcomes = outcomes.join(flipped, "edit_id", "left").withColumn("flipped", F.coalesce("flipped", F.lit(0)))
    return out.unionByName(added.select(*categories.columns)), outcomes

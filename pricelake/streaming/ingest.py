"""Ingest as a stream: observations go to an inbox, and runs are applied once all their rows are there.

A run is due when it is closed (it has a row in the runs table), as many of its rows have come as the crawler
found (``products_found``), and no earlier run of its store waits. So a run may come in several micro-batches,
and a complete run that found nothing still counts as a miss of every listing of its store. Runs that failed
are closed without their rows. Runs of one store go by (started_at, run_id); one that is closed after a later
one was applied is left to a replay of the batch operators. A run without ``products_found`` waits.

All runs that are due, of any number of stores, are applied together: one pass over their rows and the state of
their stores. Listings, category links and tag links lie in a partition a store, and only those of the stores
with due runs are rewritten, under one version whose manifest is written last (sources/versions.py). It also says
which micro-batch it comes from, so a batch that is repeated after it changes nothing. Rows of applied runs then
leave the inbox.
"""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import KEY, RAW, STATE, TUPLE, apply_runs, close_crawl_runs, merge_category_links, merge_tags, numbered_runs, upsert_store_categories
from ..sources.tables import PATH, TAGS
from ..sources.versions import Version, Versions, part_name, part_of

TYPES = {
    "store_id": "string", "sku": "string", "price": "decimal(10,2)", "promo_type": "string", "was_price": "decimal(10,2)", "unit_price": "decimal(12,4)", "member_price": "decimal(10,2)", "multibuy_quantity": "int",
    "multibuy_total": "decimal(10,2)", "first_seen_at": "timestamp", "last_seen_at": "timestamp", "price_updated_at": "timestamp", "misses": "int", "missing_since": "timestamp", "is_available": "boolean",
}
SCHEMAS = {
    "state": ", ".join([*(f"{c} {TYPES[c]}" for c in STATE), *(f"{c} string" for c in RAW)]),
    "links": "store_id string, sku string, kind string, external_id string",
    "store_categories": "store_id string, kind string, external_id string, slug string, name string, parent_kind string, parent_external_id string",
    "tag_links": "store_id string, sku string, chain string, source string, code string",
    "tags": "chain string, source string, code string, label string, labelled_at timestamp, labelled_by string",
    "snapshots": ", ".join(["store_id string, sku string, run_id string, seq long, captured_at timestamp", *(f"{c} {TYPES[c]}" for c in TUPLE), "is_on_special boolean, currency string"]),
    "runs": "run_id string, store_id string, started_at timestamp, finished_at timestamp, products_found int, snapshots_written int, status string, error_message string",
}
#: Tables of which a version adds rows; those of the others are rewritten by store, or as a whole.
ADDED = ("snapshots", "runs")
ROWS = {**{c: TYPES[c] for c in [*KEY, *TUPLE]}, "run_id": "string", "seq": "long", **dict.fromkeys(RAW, "string"), "category_path": PATH, "tags": TAGS}
INBOX = ", ".join(f"{c} {t}" for c, t in ROWS.items()) + ", batch long, r string"
ORDER = ["started_at", "run_id"]


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the present version: one of SCHEMAS."""
    v = Versions(spark, root)
    now = v.current()
    if name not in ADDED:
        return v.read(now, name, SCHEMAS[name])
    paths = [f"{root}/{name}/{n}" for n in v.names(f"{root}/{name}") if n.startswith("version=") and int(n[8:]) <= now.number]
    return spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[name])


def closed_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs that were applied, with what they found."""
    return read(spark, root, "runs")


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The present listings of all stores."""
    return read(spark, root, "state")


def _inbox(v: Versions) -> DataFrame:
    """The rows of runs that wait, with the partition ``r`` that stands for their run, so that runs are read alone."""
    if not v.names(f"{v.root}/inbox"):
        return v.spark.createDataFrame([], INBOX)
    return v.spark.read.schema(INBOX).parquet(f"{v.root}/inbox")


def _placed(v: Versions, now: Version, runs: DataFrame) -> DataFrame:
    """Runs with whether they are closed: applied, or earlier than one of their store that is."""
    newest = [(store, *at) for store, at in json.loads(now.notes.get("newest", "[]"))]
    newest = v.spark.createDataFrame(newest, "store_id string, at long, id string").select("store_id", F.struct(F.timestamp_micros("at").alias("started_at"), F.col("id").alias("run_id")).alias("newest"))
    return runs.join(newest, "store_id", "left").withColumn("closed", F.coalesce(F.struct(*ORDER) <= F.col("newest"), F.lit(False)))


def _clear(v: Versions, now: Version, runs: DataFrame) -> None:
    """Take rows of closed runs out of the inbox, also those that came late."""
    folders = [(b, r[2:]) for b in v.names(f"{v.root}/inbox") for r in v.names(f"{v.root}/inbox/{b}") if r.startswith("r=")]
    part = part_of(F.col("run_id"))
    gone = {x.part for x in _placed(v, now, runs).where(F.col("closed") & part.isin([r for _, r in folders])).select(part.alias("part")).collect()}
    for b, r in folders:
        if r in gone:
            v.fs.delete(v.path(f"{v.root}/inbox/{b}/r={r}"), True)


def due_runs(v: Versions, now: Version, runs: DataFrame) -> DataFrame:
    """Runs to apply now, by the rules above."""
    waiting = _placed(v, now, runs).where(~F.col("closed"))
    came = _inbox(v).groupBy("run_id").agg(F.count("*").alias("came"))
    failed = F.coalesce(F.col("status") == "Failed", F.lit(False))
    whole = failed | F.coalesce(F.coalesce("came", F.lit(0)) >= F.col("products_found"), F.lit(False))
    so_far = W.partitionBy("store_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    return waiting.join(came, "run_id", "left").withColumn("ready", F.min(whole).over(so_far)).where("ready").select(*runs.columns)


def apply_due(spark: SparkSession, root: str, runs_path: str, stores_path: str | None = None, batch: int | None = None) -> int:
    """Apply all runs that are due, those of a store in their order; the number of the version that holds them."""
    v = Versions(spark, root)
    now = v.current()
    if batch is not None and batch <= int(now.notes.get("batch", -1)):
        return now.number
    number = now.number + 1
    runs = spark.read.parquet(runs_path)
    at = f"{root}/due/version={number}"
    due_runs(v, now, runs).write.mode("overwrite").parquet(at)
    due = spark.read.schema(runs.schema).parquet(at)
    # Few runs are due at a time; what is listed here are their ids.
    ids = due.select("run_id", "store_id", F.unix_micros("started_at").alias("at")).collect()
    if not ids:
        _clear(v, now, runs)
        return now.number
    stores = {r.store_id for r in ids}
    parts = [part_name(s) for s in stores]
    rows = _inbox(v).where(F.col("r").isin([part_name(r.run_id) for r in ids]))
    old = lambda name: v.read(now, name, SCHEMAS[name], parts)
    state, snaps, _ = apply_runs(old("state"), rows, due, RAW)
    snaps.select(*_names("snapshots")).write.mode("overwrite").parquet(f"{root}/snapshots/version={number}")
    snaps = spark.read.schema(SCHEMAS["snapshots"]).parquet(f"{root}/snapshots/version={number}")
    close_crawl_runs(rows, snaps, due).select(*_names("runs")).write.mode("overwrite").parquet(f"{root}/runs/version={number}")
    chains = spark.read.parquet(stores_path).select("store_id", "chain") if stores_path else due.select("store_id", F.lit(None).cast("string").alias("chain")).distinct()
    tags, tag_links = merge_tags(v.read(now, "tags", SCHEMAS["tags"]), old("tag_links"), rows, due, chains)
    nodes = rows.join(numbered_runs(due).select("run_id", "run_no"), "run_id")
    new = {
        "state": (state, "store_id"), "links": (merge_category_links(old("links"), rows, due), "store_id"), "store_categories": (upsert_store_categories(nodes, old("store_categories")), "store_id"),
        "tag_links": (tag_links, "store_id"), "tags": (tags, "chain"),
    }
    held = {k: n for k, n in now.held.items() if k[0] != "tags" and k[1] not in parts}
    for name, (df, key) in new.items():
        held |= {(name, p): number for p in v.write(df.select(*_names(name)), name, key, number)}
    newest = dict(json.loads(now.notes.get("newest", "[]")))
    for r in ids:
        newest[r.store_id] = max(newest.get(r.store_id, [r.at, ""]), [r.at, r.run_id])
    notes = {"newest": json.dumps(sorted(newest.items())), "batch": str(batch if batch is not None else now.notes.get("batch", -1))}
    new = Version(number, held, notes)
    v.commit(new)
    # Only now may rows and old folders go; what a failure leaves here, the next call deletes.
    _clear(v, new, runs)
    v.prune()
    return number


def _names(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def apply_batch(root: str, runs_path: str, stores_path: str | None = None):
    """A ``foreachBatch`` function: the batch's rows to the inbox, then all runs that are due."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= int(Versions(spark, root).current().notes.get("batch", -1)):
            return
        rows = batch.select(*[(F.col(c) if c in batch.columns else F.lit(None)).cast(t).alias(c) for c, t in ROWS.items()], part_of(F.col("run_id")).alias("r"))
        rows.write.mode("overwrite").partitionBy("r").parquet(f"{root}/inbox/batch={batch_id}")
        apply_due(spark, root, runs_path, stores_path, batch_id)

    return run


def stream_ingest(observations: DataFrame, root: str, runs_path: str, checkpoint: str, stores_path: str | None = None) -> StreamingQuery:
    """Start the ingest of a stream of observations; ends when all is read.

    They have store_id, sku, run_id, seq and the price tuple, and may have the fields of RAW, category_path and tags.
    ``runs_path`` holds the closed runs, with products_found; ``stores_path`` the chain of each store, for tags. Runs
    that are closed after the last rows came are applied by the next batch, or by ``apply_due``.
    """
    cols = [c for c in ROWS if c in observations.columns]
    return observations.select(*cols).writeStream.foreachBatch(apply_batch(root, runs_path, stores_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

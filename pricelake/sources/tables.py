"""The library's tables with fixed schemas."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY, UNIT = "decimal(10,2)", "decimal(12,4)"
PROMO = f"promo_type string, member_price {MONEY}, multibuy_quantity int, multibuy_total {MONEY}"
PATH = "array<struct<kind: string, external_id: string, slug: string, name: string>>"
TAGS = "array<struct<source: string, code: string, label: string>>"
SCHEMAS = {
    "stores": "store_id string, chain string, name string, suburb string, latitude double, longitude double, external_store_id string, is_active boolean",
    "listings": "product_id string, store_id string, item_id string, sku string, raw_name string, raw_brand string, raw_size string, gtin string, url string, image_url string, "
    f"current_price {MONEY}, current_non_special_price {MONEY}, unit_price {UNIT}, unit_of_measure string, {PROMO}, is_on_special boolean, is_available boolean, "
    "consecutive_missing_runs int, first_seen_at timestamp, last_seen_at timestamp, missing_since timestamp, price_updated_at timestamp",
    "price_snapshots": f"product_id string, crawl_run_id string, price {MONEY}, non_special_price {MONEY}, unit_price {UNIT}, {PROMO}, is_on_special boolean, currency string, captured_at timestamp",
    "crawl_runs": "run_id string, store_id string, started_at timestamp, finished_at timestamp, status string, products_found int, snapshots_written int, error_message string",
    "store_categories": "store_category_id string, store_id string, kind string, external_id string, slug string, name string, parent_id string, category_id string",
    "product_store_categories": "product_id string, store_category_id string",
    "product_tags": "tag_id string, chain string, source string, code string, label string",
    "categories": "category_id string, kind string, name string, path string, slug string, parent_id string, is_archived boolean",
    "items": "item_id string, match_key string, name string, description string, brand string, size string, unit_of_measure string, category string, category_id string, gtin string, merged_into_id string",
    "match_candidates": "candidate_id string, product_id string, item_id string, score double, reason string, status string, created_at timestamp, reviewed_at timestamp",
    "scraped": f"store_id string, run_id string, seq bigint, sku string, name string, brand string, size string, gtin string, url string, image_url string, price {MONEY}, non_special_price {MONEY}, "
    f"unit_price {UNIT}, unit_of_measure string, {PROMO}, category_path {PATH}, tags {TAGS}",
}
#: Tables written by a column of their own.
PARTITIONS = {"price_snapshots": "captured_on"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str, names=tuple(SCHEMAS)) -> dict[str, DataFrame]:
    return {n: read_table(spark, root, n) for n in names}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null, others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write a table with its schema; snapshots by day of capture, so that history reads prune."""
    out = conform(df, name)
    if name in PARTITIONS:
        out = out.withColumn("captured_on", F.to_date("captured_at"))
        out.write.mode(mode).partitionBy("captured_on").parquet(f"{root}/{name}")
    else:
        out.write.mode(mode).parquet(f"{root}/{name}")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, or where none is named one in the warehouse, which they share as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/scratch").rstrip("/")


def scratch_keep(spark: SparkSession) -> Callable[..., DataFrame]:
    """A function that writes a table to the shared folder and reads it back, which cuts lineage; in folders of the columns ``by``, if given."""
    root = f"{scratch_root(spark)}/kept-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        df.write.parquet(f"{root}/{name}", mode="overwrite", partitionBy=list(by) or None)
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return keep

"""Whether the archived pages of a run are all that it should have fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_slugify
from .parsers import FOODSTUFFS_SCHEMA, WOOLWORTHS_SCHEMA

WOOLWORTHS_PAGE, FOODSTUFFS_CAP = 48, 1000
RUN = ["chain", "run_ts"]


def expected_pages(raw: DataFrame) -> DataFrame:
    """(chain, run_ts, scope, first, pages, hits, page_list): what each scope's pages say there is."""
    w, f = F.from_json("payload", WOOLWORTHS_SCHEMA), F.from_json("payload", FOODSTUFFS_SCHEMA)
    woolworths, foodstuffs = F.col("chain") == "Woolworths", F.col("chain").isin("NewWorld", "PaknSave")
    more = F.col("payload").rlike(r"rel=['\"]?next")
    pages = F.when(woolworths, F.ceil(w["products"]["totalItems"] / WOOLWORTHS_PAGE)).when(foodstuffs, f["totalPages"]).otherwise(F.col("page") + F.when(more, 1).otherwise(0)).cast("long")
    rows = raw.select(*RUN, "scope", "page", pages.alias("pages"), F.when(foodstuffs, f["totalHits"]).alias("hits"), F.when(foodstuffs, 0).otherwise(1).alias("first"))
    return rows.groupBy(*RUN, "scope").agg(F.min("first").alias("first"), F.max("pages").alias("pages"), F.max("hits").alias("hits"), F.collect_set("page").alias("page_list"))


def missing_pages(expected: DataFrame) -> DataFrame:
    """(chain, run_ts, gap) of pages that a scope lacks; a Foodstuffs scope counts from 0, the others from 1."""
    last = F.col("first") + F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)) - 1
    lack = expected.select(*RUN, "scope", "pages", F.explode(F.array_except(F.sequence(F.col("first").cast("int"), last.cast("int")), "page_list")).alias("page"))
    return lack.select(*RUN, F.concat("scope", F.lit(": page "), F.col("page").cast("string"), F.lit(" missing")).alias("gap"))


def missing_facets(raw: DataFrame) -> DataFrame:
    """(chain, run_ts, gap): aisles and shelves that a Woolworths scope's facets name and no archived scope covers."""
    own = raw.where("chain = 'Woolworths'")
    rows = own.select(*RUN, "scope", F.explode(F.from_json("payload", WOOLWORTHS_SCHEMA)["dasFacets"]).alias("f"))
    depth = F.size(F.split("scope", "__"))
    wanted = rows.where(F.lower("f.group") == F.when(depth == 1, "aisle").when(depth == 2, "shelf")).where("trim(f.name) <> ''")
    wanted = wanted.select(*RUN, F.concat("scope", F.lit("__"), source_slugify(F.col("f.name"))).alias("scope")).distinct()
    there = own.select(*RUN, "scope").distinct()
    return wanted.join(there, [*RUN, "scope"], "left_anti").select(*RUN, F.concat("scope", F.lit(": not archived")).alias("gap"))


def truncated(expected: DataFrame) -> DataFrame:
    """(chain, run_ts, gap): Foodstuffs scopes at the cap of hits that no sub-scope (``scope - part``) splits."""
    full = expected.where(F.col("hits") >= FOODSTUFFS_CAP).select(*RUN, "scope")
    parents = expected.select(*RUN, F.regexp_extract("scope", "^(.*) - [^-]*$", 1).alias("scope")).where("scope <> ''").distinct()
    return full.join(parents, [*RUN, "scope"], "left_anti").select(*RUN, F.concat("scope", F.lit(": truncated")).alias("gap"))


def split_scopes(expected: DataFrame) -> DataFrame:
    """Scopes at the cap that sub-scopes cover: their own further pages are not asked for."""
    full = expected.where(F.col("hits") >= FOODSTUFFS_CAP).select(*RUN, "scope")
    parents = expected.select(*RUN, F.regexp_extract("scope", "^(.*) - [^-]*$", 1).alias("scope")).where("scope <> ''").distinct()
    return full.join(parents, [*RUN, "scope"], "left_semi")


def crawl_coverage(raw: DataFrame) -> DataFrame:
    """(chain, run_ts, gaps, complete) of each run: complete where there is no gap.

    A FreshChoice department without a first page is empty, not a gap; its later pages are asked for as long
    as the last one names a next.
    """
    expected = expected_pages(raw)
    paged = expected.join(split_scopes(expected), [*RUN, "scope"], "left_anti")
    gaps = missing_pages(paged).union(missing_facets(raw)).union(truncated(expected))
    listed = gaps.groupBy(*RUN).agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    runs = raw.select(*RUN).distinct().join(listed, RUN, "left")
    none = F.array().cast("array<string>")
    return runs.select(*RUN, F.coalesce("gaps", none).alias("gaps"), F.col("gaps").isNull().alias("complete"))

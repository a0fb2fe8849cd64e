"""All queries of the library on derived tables, each with the SQL that must agree with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing, text
from ..operators import catalog, categories, curation, deals, history, ingest, matching, reports
from ..operators.matching import ITEM
from ..sources.archive import from_path, retained_runs
from ..sources.coverage import crawl_coverage
from ..sources.parsers import parse_foodstuffs, parse_freshchoice, parse_woolworths
from ..sources.tables import SCHEMAS, conform, read_table, scratch_keep, scratch_root, write_table
from ..sources.versions import read_parts, replace_parts
from .derive import NOW, Tables, flat, seconds, with_tables

CLOCK = datetime.fromtimestamp(NOW, UTC)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the tables; its SQL names tables in braces."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: flat(f(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = with_tables(sql)
        return f

    return add


def _keep(t):
    return scratch_keep(t.spark)


# ---- scalar functions -------------------------------------------------------------------------------------------

NORM_BRAND = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '')"
NORM_SIZE = "CASE WHEN regexp_matches({0}, '[0-9]') THEN regexp_replace(replace(lower({0}), ' ', ''), 'packs?|pkts?', 'pk', 'g') END"
TOKENS = """list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^a-z0-9]+')),
  lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') AND NOT regexp_full_match(w, '[0-9]+(\\.[0-9]+)?(g|kg|ml|l|pk|pack|ea|cm|mm|pc|pcs)')
  AND NOT list_contains(['the','a','an','and','with','of','in','for','to','or','no','nz'], w)
  AND NOT list_contains(regexp_split_to_array(coalesce({1}, ''), ' '), w))"""
UNIT = """CASE WHEN {0} IS NOT NULL THEN CASE {1} WHEN '1kg' THEN {0} WHEN '100g' THEN {0} / 100 * 1000 WHEN '1L' THEN {0} WHEN '250ml' THEN {0} / 250 * 1000 WHEN 'ea' THEN {0} END END"""


@query(f"SELECT p_partkey AS k, {NORM_BRAND.format('p_brand')} AS brand, {NORM_BRAND.format(chr(39) + ' -- ' + chr(39) + ' || p_type')} AS other FROM {{part}}")
def f1_normalize_brand(t):
    return t.part.select(F.col("p_partkey").alias("k"), text.normalize_brand(F.col("p_brand")).alias("brand"), text.normalize_brand(F.concat(F.lit(" -- "), "p_type")).alias("other"))


_SIZE = "CASE p_size % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), ' Packs') WHEN 1 THEN concat(CAST(p_size AS STRING), ' x 100 ML') WHEN 2 THEN 'kg' ELSE concat(CAST(p_size AS STRING), 'pkt') END"


@query(f"SELECT p_partkey AS k, {NORM_SIZE.format('(' + _SIZE + ')')} AS size FROM {{part}}")
def f2_normalize_size(t):
    return t.part.select(F.col("p_partkey").alias("k"), text.normalize_size(F.expr(_SIZE)).alias("size"))


@query(f"SELECT doc_id, array_to_string(list_sort({TOKENS.format('coalesce(text, ' + chr(39) * 2 + ')', 'NULL')}), ' ') AS tokens FROM {{documents}}")
def f3_tokenize(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(text.tokenize(F.col("text"), F.lit(None).cast("string"))), " ").alias("tokens"))


@query(
    f"""SELECT a.p_partkey AS k, CASE WHEN least(len(a.t), len(b.t)) > 0 THEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))::DOUBLE ELSE 0.0::DOUBLE END AS overlap
FROM (SELECT p_partkey, {TOKENS.format("p_name || ' extra ' || p_type", NORM_BRAND.format("p_brand"))} AS t FROM {{part}}) a
JOIN (SELECT p_partkey - 1 AS k, {TOKENS.format("p_name || ' ' || p_type", NORM_BRAND.format("p_brand"))} AS t FROM {{part}}) b ON a.p_partkey = b.k"""
)
def f4_token_overlap(t):
    a = t.part.select(F.col("p_partkey").alias("k"), text.tokenize(F.concat("p_name", F.lit(" extra "), "p_type"), F.col("p_brand")).alias("a"))
    b = t.part.select((F.col("p_partkey") - 1).alias("k"), text.tokenize(F.concat("p_name", F.lit(" "), "p_type"), F.col("p_brand")).alias("b"))
    return a.join(b, "k").select("k", text.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(
    f"""SELECT product_id, round(CAST({UNIT.format('CAST(unit_price AS DOUBLE)', 'unit_of_measure')} AS DOUBLE), 4) AS price,
CASE WHEN unit_price IS NOT NULL THEN CASE unit_of_measure WHEN '1kg' THEN '1kg' WHEN '100g' THEN '1kg' WHEN '1L' THEN '1L' WHEN '250ml' THEN '1L' WHEN 'ea' THEN '1ea' END END AS unit FROM {{listings}}"""
)
def f5_comparable_unit_price(t):
    u = pricing.comparable_unit_price(F.col("unit_price"), F.col("unit_of_measure"))
    return t.listings.select("product_id", F.round(u["price"].cast("double"), 4).alias("price"), u["unit"].alias("unit"))


_NAME = "concat('  ', p_name, ' & Co''s ', p_brand, '!')"


@query(None)
def f6_slugify(t):
    return t.part.select(F.col("p_partkey").alias("k"), text.slugify(F.expr(_NAME)).alias("slug"))


@query(None)
def f7_source_slugify(t):
    return t.part.select(F.col("p_partkey").alias("k"), text.source_slugify(F.expr(_NAME)).alias("slug"))


ORACLES["f6_slugify"] = "SELECT p_partkey AS k, regexp_replace(regexp_replace(lower(trim(concat('  ', p_name, ' & Co''s ', p_brand, '!'))), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part"
ORACLES["f7_source_slugify"] = (
    "SELECT p_partkey AS k, regexp_replace(regexp_replace(lower(trim(replace(concat('  ', p_name, ' & Co''s ', p_brand, '!'), '''', ''))), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part"
)


@query(
    """WITH v AS (SELECT DISTINCT trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS brand FROM {part}),
l AS (SELECT product_id, regexp_split_to_array(raw_name, ' ') AS w FROM {listings}),
p AS (SELECT product_id, n, array_to_string(w[1:n], ' ') AS phrase FROM l, (VALUES (1), (2), (3)) x(n) WHERE len(w) >= n)
SELECT product_id, max_by(phrase, n) AS inferred FROM p JOIN v ON trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) = v.brand GROUP BY product_id"""
)
def f8_infer_brand(t):
    return text.infer_brand(t.listings, t.part.select(text.normalize_brand(F.col("p_brand")).alias("brand")).distinct())


@query("SELECT store_id, CASE chain WHEN 'Woolworths' THEN 'Everyday Rewards' WHEN 'NewWorld' THEN 'New World Clubcard' END AS programme FROM {stores}")
def f9_loyalty_program(t):
    return t.stores.select("store_id", pricing.loyalty_program(F.col("chain")).alias("programme"))


@query(
    "SELECT product_id, coalesce(lower(unit_of_measure) IN ('1kg', '1l') AND abs(CAST(current_price AS DECIMAL(14,4)) - CAST(unit_price AS DECIMAL(14,4))) < 0.001, false) AS variable FROM {listings}"
)
def f10_is_variable_weight(t):
    return t.listings.select("product_id", pricing.is_variable_weight(F.col("current_price"), F.col("unit_price"), F.col("unit_of_measure")).alias("variable"))


# ---- read models ------------------------------------------------------------------------------------------------

FOUND = """found AS (SELECT l.*, s.chain, s.name AS store_name, s.suburb, coalesce(l.item_id, l.product_id) AS group_id FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id
  WHERE s.is_active AND l.is_available AND l.current_price IS NOT NULL)"""
ALL = """j AS (SELECT l.*, s.chain, s.name AS store_name, s.suburb FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id)"""
LOCAL = "CAST(epoch(timezone('Pacific/Auckland', to_timestamp({0}))) AS BIGINT)"


@query(f"WITH {FOUND} SELECT product_id, chain, CAST(current_price AS DOUBLE) AS price FROM found WHERE store_id IN ('1', '2', '3') AND (raw_name ILIKE '%ring%' OR raw_brand ILIKE '%ring%')")
def r1_find_listings(t):
    return catalog.find_listings(t.listings, t.stores, " RING ", ["1", "2", "3"]).select("product_id", "chain", F.col("current_price").alias("price"))


@query(f"WITH {FOUND} SELECT product_id, chain, CAST(current_price AS DOUBLE) AS price FROM found WHERE raw_name ILIKE '%_mall%gi_mo%' OR raw_brand ILIKE '%_mall%gi_mo%'")
def r1_search_listings(t):
    postings = catalog.write_postings(t.listings, _keep(t))
    return catalog.search_listings(t.listings, t.stores, postings, "_MALL%gi_mo").select("product_id", "chain", F.col("current_price").alias("price"))


@query(
    """WITH ids AS (SELECT category_id FROM {categories} WHERE path LIKE 'economy%')
SELECT l.product_id FROM {listings} l WHERE (item_id IS NOT NULL AND EXISTS (SELECT 1 FROM {items} i WHERE i.item_id = l.item_id AND i.category_id IN (SELECT category_id FROM ids)))
 OR (item_id IS NULL AND EXISTS (SELECT 1 FROM {product_store_categories} k JOIN {store_categories} c ON k.store_category_id = c.store_category_id WHERE k.product_id = l.product_id AND c.category_id IN (SELECT category_id FROM ids)))"""
)
def r2_in_category(t):
    ids = t.categories.where("path like 'economy%'").select("category_id")
    return catalog.in_category(t.listings, ids, t.items, t.product_store_categories, t.store_categories).select("product_id")


GROUPS = f"""{FOUND}, g AS (SELECT group_id, count(*) AS n_listings, count(*) > 1 AS comparable, CAST(min(current_price) AS DOUBLE) AS min_price,
  max(CAST(current_non_special_price - current_price AS DOUBLE)) AS max_saving, array_to_string(list(product_id ORDER BY current_price, product_id), ',') AS members,
  min({UNIT.format('CAST(unit_price AS DOUBLE)', 'unit_of_measure')}) AS unit_raw, arg_min(raw_name, (current_price, product_id)) AS name FROM found GROUP BY group_id)"""


def _groups(t):
    g = catalog.product_groups(catalog.find_listings(t.listings, t.stores))
    return g.withColumn("members", F.array_join(F.transform("listings", lambda x: x["product_id"]), ",")).drop("listings")


@query(f"WITH {GROUPS} SELECT group_id, n_listings, comparable, min_price, max_saving, members, round(unit_raw, 1) AS unit FROM g")
def r3_product_groups(t):
    return _groups(t).select("group_id", "n_listings", "comparable", "min_price", "max_saving", "members", F.round(F.col("min_unit_price").cast("double"), 1).alias("unit"))


@query(f"WITH {FOUND} SELECT item_id, count(DISTINCT store_id) AS n_stores FROM found WHERE item_id IS NOT NULL GROUP BY item_id")
def r4_store_span(t):
    return catalog.store_span(t.listings, t.stores)


PLACES = {"priceAsc": "min_price", "nameAsc": "0", "discountDesc": "max_saving DESC", "unitPriceAsc": "round(coalesce(unit_raw, min_price), 6)"}


def _placed_groups(sort):
    def places(t):
        return catalog.placed(_groups(t), catalog.sort_keys(sort), _keep(t)).select("group_id", "place")

    return places


for _sort, _key in PLACES.items():
    _name = "r5_sort_groups" if _sort == "priceAsc" else f"r5_sort_groups_{_sort}"
    query(f"WITH {GROUPS} SELECT group_id, row_number() OVER (ORDER BY {_key} NULLS LAST, lower(name), group_id) AS place FROM g", _name)(_placed_groups(_sort))


@query(f"WITH {GROUPS} SELECT group_id, min_price FROM g ORDER BY max_saving DESC NULLS LAST, lower(name), group_id LIMIT 40 OFFSET 80")
def r6_page(t):
    rows, _ = catalog.page(_groups(t), catalog.sort_keys("discountDesc"), 3, 40)
    return rows.select("group_id", "min_price")


@query(f"WITH {GROUPS} SELECT count(*) AS total, CAST(ceil(count(*) / 40.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 40.0) AS has_more FROM g")
def r6_page_figures(t):
    return catalog.page(_groups(t), catalog.sort_keys(None), 3, 40)[1]


@query(f"WITH {GROUPS}, o AS (SELECT group_id, min_price, row_number() OVER (ORDER BY max_saving DESC NULLS LAST, lower(name), group_id) AS place FROM g) SELECT * FROM o WHERE place > (SELECT (max(place) - 1) // 40 * 40 FROM o)")
def r6_last_page(t):
    index = catalog.PageIndex(_groups(t).select("group_id", "name", "min_price", "max_saving"), catalog.sort_keys("discountDesc"), _keep(t))
    return index.page(index.figures(size=40)[1], 40).select("group_id", "min_price", "place")


@query(f"WITH {FOUND} SELECT product_id, CAST(current_price AS DOUBLE) AS price FROM {{listings}} WHERE is_available AND current_price IS NOT NULL AND coalesce(item_id, product_id) = (SELECT coalesce(item_id, product_id) FROM {{listings}} WHERE product_id = (SELECT min(product_id) FROM {{listings}} WHERE item_id IS NOT NULL))")
def r7_group_for(t):
    first = t.listings.where("item_id is not null").agg(F.min("product_id")).first()[0]
    return catalog.group_for(t.listings, first).select("product_id", F.col("current_price").alias("price"))


COMPARE = f"""{ALL}, c AS (SELECT i.item_id, i.name AS product, i.brand, i.size, i.category, chain, store_name, suburb, product_id, raw_name, CAST(current_price AS DOUBLE) AS price, is_on_special AS on_special,
  CAST(current_non_special_price AS DOUBLE) AS was_price, CAST(unit_price AS DOUBLE) AS unit_price, unit_of_measure AS uom, {LOCAL.format('last_seen_at')} AS last_seen FROM j JOIN {{items}} i ON j.item_id = i.item_id)"""


@query(f"WITH {COMPARE} SELECT * FROM c")
def r8_product_compare(t):
    return catalog.product_compare(t.items, t.listings, t.stores)


@query(
    f"""WITH {COMPARE}, n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY price NULLS LAST, store_name, product_id) AS rn, count(*) OVER (PARTITION BY item_id) AS store_count, max(price) OVER (PARTITION BY item_id) AS max_price FROM c)
SELECT item_id, product, brand, size, category, price AS cheapest_price, store_name AS cheapest_store, chain, store_count, max_price, round(max_price - price, 2) AS spread FROM n WHERE rn = 1"""
)
def cheapest_by_product(t):
    return catalog.cheapest_by_product(t.items, t.listings, t.stores)


SPECIALS = f"""{ALL} SELECT product_id, chain, store_name, raw_name AS product, raw_brand AS brand, CAST(current_price AS DOUBLE) AS price, CAST(current_non_special_price AS DOUBLE) AS was_price,
 CAST(current_non_special_price - current_price AS DOUBLE) AS saving, round(CAST(100 * (current_non_special_price - current_price) AS DOUBLE) / CAST(current_non_special_price AS DOUBLE), 0) AS pct_off,
 CAST(unit_price AS DOUBLE) AS unit_price, unit_of_measure AS uom, item_id FROM j WHERE is_on_special AND current_non_special_price IS NOT NULL AND current_price IS NOT NULL"""


@query(f"WITH {SPECIALS}")
def r10_current_specials(t):
    return deals.current_specials(t.listings.where("current_price is not null"), t.stores)


DEALS = f"""{ALL}, deal AS (SELECT *, CAST(current_non_special_price - current_price AS DOUBLE) AS saving, coalesce(item_id, product_id) AS group_id,
  coalesce(CAST(current_non_special_price - current_price AS DOUBLE) / CAST(current_non_special_price AS DOUBLE), 0) AS share_off,
  CASE WHEN coalesce(lower(unit_of_measure) IN ('1kg', '1l') AND abs(CAST(current_price AS DOUBLE) - CAST(unit_price AS DOUBLE)) < 0.001, false) THEN 0.0 ELSE coalesce(CAST(current_non_special_price - current_price AS DOUBLE), 0.0) END AS real_saving
  FROM j JOIN (SELECT store_id AS sid FROM {{stores}} WHERE is_active) a ON store_id = sid WHERE is_available AND is_on_special AND current_price IS NOT NULL AND last_seen_at >= {NOW} - 48 * 3600)"""


def _deals(t):
    return deals.deals(t.listings, t.stores, CLOCK)


@query(f"WITH {DEALS} SELECT product_id, chain, saving FROM deal")
def r11_deals(t):
    return _deals(t).select("product_id", "chain", "saving")


@query(f"WITH {DEALS} SELECT product_id, saving FROM deal ORDER BY saving IS NULL, saving DESC, product_id LIMIT 50 OFFSET 50")
def r11_deals_page(t):
    return catalog.page(_deals(t), deals.deal_order(), 2, 50)[0].select("product_id", "saving")


@query(f"WITH {DEALS} SELECT product_id, share_off, real_saving, row_number() OVER (ORDER BY round(share_off, 12) DESC, saving DESC NULLS LAST, product_id) AS place FROM deal")
def r12_rank_deals_percent(t):
    return catalog.placed(deals.ranked(_deals(t)), deals.rank_order("percent"), _keep(t)).select("product_id", "share_off", "real_saving", "place")


@query(f"WITH {DEALS} SELECT product_id, share_off, real_saving, row_number() OVER (ORDER BY real_saving DESC, round(share_off, 12) DESC, product_id) AS place FROM deal")
def r12_rank_deals_saving(t):
    return catalog.placed(deals.ranked(_deals(t)), deals.rank_order("saving"), _keep(t)).select("product_id", "share_off", "real_saving", "place")


@query(f"WITH {DEALS} SELECT product_id, saving FROM deal WHERE share_off >= 0.3 AND saving >= 1 ORDER BY share_off DESC, saving DESC, product_id LIMIT 30")
def r13_showcase_deals(t):
    return deals.showcase_deals(_deals(t), "percent").select("product_id", "saving")


@query(f"WITH {FOUND} SELECT group_id, count(*) AS n_listings FROM found WHERE multibuy_total IS NOT NULL GROUP BY group_id")
def r14_filter_promo(t):
    return catalog.product_groups(catalog.filter_promo(catalog.find_listings(t.listings, t.stores), "multibuy")).select("group_id", "n_listings")


@query(
    f"""WITH {FOUND} SELECT group_id, product_id FROM (SELECT group_id, product_id, row_number() OVER (PARTITION BY group_id ORDER BY
 coalesce(round({UNIT.format('CAST(unit_price AS DOUBLE)', 'unit_of_measure')}, 4), CAST(current_price AS DOUBLE)), product_id) AS rn FROM found) x WHERE rn = 1"""
)
def r15_best_listing_per_group(t):
    return catalog.best_listing_per_group(catalog.find_listings(t.listings, t.stores)).select("group_id", "product_id")


@query(
    """SELECT *, CASE WHEN n_priced = 0 THEN 'no data' WHEN n_priced = 1 THEN 'single' WHEN gap <= 0.009 THEN 'same' ELSE 'gap' END AS status FROM (
SELECT coalesce(item_id, product_id) AS group_id, count(current_price) AS n_priced, CAST(min(current_price) AS DOUBLE) AS min_price, CAST(max(current_price) AS DOUBLE) AS max_price, CAST(max(current_price) - min(current_price) AS DOUBLE) AS gap
FROM {listings} GROUP BY 1) x"""
)
def r16_price_gap(t):
    return catalog.price_gap(t.listings)


@query(
    f"""WITH {DEALS}, g AS (SELECT coalesce(item_id, product_id) AS group_id, CAST(min(current_price) AS DOUBLE) AS lowest, CAST(max(current_price) AS DOUBLE) AS highest, arg_min(store_id, (current_price, store_id)) AS cheapest_store_id
  FROM {{listings}} WHERE is_available AND current_price IS NOT NULL GROUP BY 1)
SELECT product_id, CAST(current_price AS DOUBLE) <= lowest + 0.009 AS is_lowest, round(highest - CAST(current_price AS DOUBLE), 2) AS top_gap, cheapest_store_id FROM deal JOIN g USING (group_id)"""
)
def r17_deal_price_status(t):
    out = deals.deal_price_status(_deals(t), t.listings)
    return out.select("product_id", "is_lowest", F.round("top_gap", 2).alias("top_gap"), "cheapest_store_id")


BRANCH = f"""{COMPARE}, b AS (SELECT item_id, product, chain, count(*) AS branches, min(price) AS min_price, max(price) AS max_price, round(max(price) - min(price), 2) AS spread FROM c GROUP BY item_id, product, chain)"""


@query(f"WITH {BRANCH} SELECT * FROM b WHERE branches > 1 AND min_price <> max_price")
def r18_branch_price_variation(t):
    return catalog.branch_price_variation(t.items, t.listings, t.stores)


@query(
    f"""WITH {BRANCH} SELECT chain, count(*) AS products, count_if(min_price <> max_price) AS differing, count_if(min_price <> max_price) * 100.0::DOUBLE / count(*) AS percent,
 round(avg(CASE WHEN min_price <> max_price THEN spread END), 6) AS avg_gap, max(spread) AS max_gap FROM b WHERE branches > 1 GROUP BY chain"""
)
def t16_branch_variation_rate(t):
    return catalog.branch_variation_rate(t.items, t.listings, t.stores).withColumn("avg_gap", F.round("avg_gap", 6)).withColumn("percent", F.col("percent").cast("double"))


# ---- history ----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT l.item_id, s.chain, s.name AS store_name, p.product_id, l.raw_name AS product, {LOCAL.format('p.captured_at')} AS captured_at, CAST(p.price AS DOUBLE) AS price, CAST(p.non_special_price AS DOUBLE) AS was_price,
 p.is_on_special AS on_special, CAST(p.unit_price AS DOUBLE) AS unit_price FROM {{snapshots}} p JOIN {{listings}} l ON p.product_id = l.product_id JOIN {{stores}} s ON l.store_id = s.store_id"""
)
def h1_price_history_view(t):
    return history.price_history_view(t.snapshots, t.listings, t.stores)


@query(
    """SELECT coalesce(l.item_id, l.product_id) AS group_id, p.product_id, s.name AS store_name, count(*) AS n_points, array_to_string(list(CAST(captured_at AS STRING) ORDER BY captured_at, price), ',') AS times
FROM {snapshots} p JOIN {listings} l ON p.product_id = l.product_id JOIN {stores} s ON l.store_id = s.store_id GROUP BY 1, 2, 3"""
)
def h2_group_price_history(t):
    out = history.group_price_history(t.snapshots, t.listings, t.stores)
    return out.select("group_id", "product_id", "store_name", F.size("points").cast("long").alias("n_points"), F.array_join(F.transform("points", lambda p: F.unix_timestamp(p["captured_at"]).cast("string")), ",").alias("times"))


@query("SELECT product_id, captured_at, CAST(price AS DOUBLE) AS price, lead(captured_at) OVER (PARTITION BY product_id ORDER BY captured_at) AS valid_until FROM {snapshots}")
def h3_price_intervals(t):
    return history.price_intervals(t.snapshots).select("product_id", "captured_at", "price", "valid_until")


AS_OF = """WITH q AS (SELECT o_orderkey AS q, concat(CAST(l_partkey AS STRING), '@', CAST(l_suppkey % 10 AS STRING)) AS product_id, EPOCH(o_orderdate) + 86400 * (l_linenumber * 40) AS at, l_linenumber AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)
SELECT q.q, q.n, q.product_id, q.at, CAST(s.price AS DOUBLE) AS price, s.captured_at AS since FROM q ASOF LEFT JOIN {snapshots} s ON q.product_id = s.product_id AND q.at >= s.captured_at"""


def _moments(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("q"), F.col("l_linenumber").alias("n"), F.concat(F.col("l_partkey").cast("string"), F.lit("@"), (F.col("l_suppkey") % 10).cast("string")).alias("product_id"),
        F.timestamp_seconds(F.expr(seconds("o_orderdate")) + 86400 * 40 * F.col("l_linenumber")).alias("at"),
    )


@query(AS_OF)
def h4_price_as_of(t):
    return history.price_as_of(_moments(t), t.snapshots)


@query(AS_OF)
def h4_price_as_of_in_ranges(t):
    return history.price_as_of(_moments(t), t.snapshots, _keep(t))


@query(
    """WITH a AS (SELECT *, lead(captured_at) OVER w AS until_, CASE WHEN promo_type IS NOT DISTINCT FROM lag(promo_type) OVER w THEN 0 ELSE 1 END AS new_ FROM {snapshots} WINDOW w AS (PARTITION BY product_id ORDER BY captured_at)),
b AS (SELECT *, sum(new_) OVER (PARTITION BY product_id ORDER BY captured_at) AS island FROM a)
SELECT product_id, promo_type, min(captured_at) AS started, arg_max(until_, captured_at) FILTER (WHERE true) AS ended_, CAST(min(price) AS DOUBLE) AS lowest, count(*) AS n_snapshots FROM b WHERE promo_type <> 'None' GROUP BY product_id, island, promo_type""".replace(
        "arg_max(until_, captured_at) FILTER (WHERE true) AS ended_", "max(CASE WHEN last_ THEN until_ END) AS ended"
    ).replace("b AS (SELECT *, sum(new_)", "b AS (SELECT *, coalesce(lead(new_) OVER (PARTITION BY product_id ORDER BY captured_at), 1) = 1 AS last_, sum(new_)")
)
def h5_promo_windows(t):
    # There are no more snapshots than lines, whose number lies in the file's footer.
    return history.promo_windows(t.snapshots, t.lineitem.count())


@query(
    f"""WITH r AS (SELECT coalesce(l.item_id, l.product_id) AS group_id, l.store_id, s.captured_at, s.price, s.product_id FROM {{snapshots}} s JOIN {{listings}} l ON s.product_id = l.product_id WHERE s.captured_at >= {NOW} - 86400 * 10000),
f AS (SELECT group_id, store_id, arg_max(price, (captured_at, product_id)) AS latest, min(price) AS lo, max(price) AS hi, count(*) AS n FROM r GROUP BY 1, 2)
SELECT group_id, CAST(min(lo) AS DOUBLE) AS min_price, CAST(max(hi) AS DOUBLE) AS max_price, CAST(sum(n) AS BIGINT) AS n_points, CAST(min(latest) AS DOUBLE) AS lowest_latest, count(*) AS n_stores FROM f GROUP BY 1"""
)
def h6_history_trend(t):
    return history.history_trend(t.snapshots, t.listings, CLOCK, 10000)


# ---- reports ----------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT s.chain, l.promo_type FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id WHERE s.is_active),
g AS (SELECT chain, count(*) AS total, count_if(promo_type = 'None') AS none, count_if(promo_type = 'Special') AS special, count_if(promo_type = 'MemberPrice') AS member, count_if(promo_type = 'Multibuy') AS multibuy FROM r GROUP BY ROLLUP(chain))
SELECT coalesce(chain, 'TOTAL') AS chain, total, none, special, member, multibuy, CAST(round_even(100.0 * (total - none) / total, 0) AS BIGINT) AS promo_percent,
 CASE chain WHEN 'Woolworths' THEN 'Everyday Rewards' WHEN 'NewWorld' THEN 'New World Clubcard' END AS programme FROM g"""
)
def t1_promo_report(t):
    return reports.promo_report(t.listings, t.stores)


STATUS = """status AS (SELECT s.chain, CASE WHEN i.match_key IS NOT NULL THEN split_part(i.match_key, ':', 1) END AS scheme, EXISTS (SELECT 1 FROM {candidates} c WHERE c.product_id = l.product_id AND c.status = 'Pending') AS has_pending, count(*) AS n
  FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id LEFT JOIN {items} i ON l.item_id = i.item_id WHERE s.is_active GROUP BY 1, 2, 3)"""
REPORT = f"""{STATUS}, ch(chain) AS (VALUES ('Woolworths'), ('NewWorld'), ('PaknSave'), ('FreshChoice')), report AS (
  SELECT coalesce(ch.chain, 'Total') AS chain, CAST(coalesce(sum(n) FILTER (WHERE scheme = 'foodstuffs'), 0) AS BIGINT) AS foodstuffs, CAST(coalesce(sum(n) FILTER (WHERE scheme = 'woolworths'), 0) AS BIGINT) AS woolworths,
  CAST(coalesce(sum(n) FILTER (WHERE scheme = 'freshchoice'), 0) AS BIGINT) AS freshchoice, CAST(coalesce(sum(n) FILTER (WHERE scheme NOT IN ('foodstuffs', 'woolworths', 'freshchoice')), 0) AS BIGINT) AS manual,
  CAST(coalesce(sum(n) FILTER (WHERE scheme IS NULL AND has_pending), 0) AS BIGINT) AS pending, CAST(coalesce(sum(n) FILTER (WHERE scheme IS NULL AND NOT has_pending), 0) AS BIGINT) AS held, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
  FROM ch LEFT JOIN status ON ch.chain = status.chain GROUP BY ROLLUP(ch.chain))"""


def _status(t):
    return reports.match_status_counts(t.listings, t.stores, t.items, t.candidates)


@query(f"WITH {STATUS} SELECT * FROM status")
def t2_match_status_counts(t):
    return _status(t)


@query(f"WITH {REPORT} SELECT * FROM report")
def t3_product_status_report(t):
    return reports.product_status_report(_status(t))


@query(f"WITH {REPORT} SELECT chain, foodstuffs + woolworths + freshchoice + manual AS linked, total, CASE WHEN total > 0 THEN (foodstuffs + woolworths + freshchoice + manual) * 100.0::DOUBLE / total ELSE 0.0 END AS percent FROM report")
def t4_coverage_percent(t):
    out = reports.coverage_percent(reports.product_status_report(_status(t)))
    return out.withColumn("percent", F.col("percent").cast("double"))


RUNS = """r AS (SELECT *, CASE WHEN status = 'Failed' THEN 'Failed' WHEN complete THEN 'Succeeded' ELSE 'Partial' END AS state FROM {runs})"""


def _runs(t):
    return t.runs.withColumn("status", F.when(F.col("status") == "Failed", "Failed").when(F.col("complete"), "Succeeded").otherwise("Partial"))


STATS = f"""{RUNS}, stats AS (SELECT s.store_id, s.chain, s.name AS store_name, (SELECT count(*) FROM {{listings}} l WHERE l.store_id = s.store_id AND l.current_price IS NOT NULL) AS n_priced,
  (SELECT max(finished_at) FROM r WHERE r.store_id = s.store_id AND state = 'Succeeded') AS last_crawl FROM {{stores}} s WHERE s.is_active)"""


@query(f"WITH {STATS} SELECT * FROM stats")
def t5_store_stats(t):
    return reports.store_stats(t.stores, t.listings, _runs(t))


CLOSED = """closed AS (SELECT r.run_id, r.store_id, r.started_at, r.finished_at, CASE WHEN r.state = 'Failed' THEN 0 ELSE count(o.seq) END AS products_found, r.state AS status, r.error_message
  FROM r LEFT JOIN {observations} o ON r.run_id = o.run_id GROUP BY ALL)"""


@query(
    f"""WITH {RUNS} SELECT r.run_id, {LOCAL.format('started_at')} AS started, {LOCAL.format('finished_at')} AS finished, finished_at - started_at AS seconds, s.name AS store_name, s.chain, state AS status, r.error_message
FROM r JOIN {{stores}} s ON r.store_id = s.store_id"""
)
def t6_crawl_run_report(t):
    rows = _runs(t).withColumns({"products_found": F.lit(0), "snapshots_written": F.lit(0)})
    return reports.crawl_run_report(rows, t.stores).drop("products_found", "snapshots_written")


@query(f"WITH {STATS} SELECT store_id, last_crawl, last_crawl IS NULL OR last_crawl < (SELECT max(finished_at) FROM r) - 48 * 3600 AS stale FROM stats")
def t7_staleness(t):
    last = t.runs.agg(F.max(F.unix_timestamp("finished_at"))).first()[0]
    return reports.staleness(reports.store_stats(t.stores, t.listings, _runs(t)), datetime.fromtimestamp(last, UTC)).select("store_id", "last_crawl", "stale")


@query(f"SELECT product_id, last_seen_at FROM {{listings}} WHERE last_seen_at < {NOW} - 36 * 3600")
def t7_stale_listings(t):
    return reports.stale_listings(t.listings, CLOCK).select("product_id", "last_seen_at")


QUEUE = """queue AS (SELECT c.candidate_id, c.product_id, c.item_id, c.score, c.reason, s.chain, s.name AS store_name, l.raw_name, l.raw_brand, l.raw_size, CAST(l.current_price AS DOUBLE) AS current_price, i.name AS item_name, i.brand AS item_brand, i.size AS item_size
  FROM {candidates} c JOIN {listings} l ON c.product_id = l.product_id JOIN {stores} s ON l.store_id = s.store_id JOIN {items} i ON c.item_id = i.item_id WHERE c.status = 'Pending')"""
_QUEUE = ["candidate_id", "product_id", "item_id", "score", "reason", "chain", "store_name", "raw_name", "raw_brand", "raw_size", "current_price", "item_name", "item_brand", "item_size"]


def _queue(t):
    return reports.review_queue(t.candidates, t.listings, t.stores, t.items)


@query(f"WITH {QUEUE} SELECT * FROM queue")
def t8_review_queue(t):
    return _queue(t).select(*_QUEUE)


@query(f"WITH {QUEUE} SELECT candidate_id, score FROM queue ORDER BY score DESC, raw_name, candidate_id LIMIT 100")
def t8_review_queue_page(t):
    return catalog.page(_queue(t), reports.queue_order(), 1, 200)[0].select("candidate_id", "score")


@query(
    f"""WITH {QUEUE} SELECT product_id, max(score) AS top_score, count(*) AS n_candidates, min(raw_name) AS raw_name, array_to_string(list(item_id ORDER BY score DESC, item_id), ',') AS items FROM queue
WHERE lower(concat_ws(chr(10), raw_name, raw_brand, raw_size, chain, store_name, item_name, item_brand, item_size, reason)) LIKE '%bolt%' GROUP BY product_id"""
)
def t9_review_groups(t):
    out = reports.review_groups(_queue(t), " Bolt")
    return out.select("product_id", "top_score", "n_candidates", "raw_name", F.array_join(F.transform("candidates", lambda c: c["item_id"]), ",").alias("items"))


# ---- ingest -----------------------------------------------------------------------------------------------------

STATE = """rn AS (SELECT *, row_number() OVER w AS run_no, sum(CAST(complete AS INT)) OVER w AS c_incl, sum(CAST(complete AS INT)) OVER w - CAST(complete AS INT) AS c_before FROM {runs} WHERE status IS NULL WINDOW w AS (PARTITION BY store_id ORDER BY started_at, run_id)),
o1 AS (SELECT o.*, run_no, c_incl, c_before, started_at AS captured_at FROM {observations} o JOIN rn ON o.run_id = rn.run_id),
o2 AS (SELECT *, promo_type = 'Special' AS on_, coalesce(c_before - lag(c_incl) OVER w >= 2, false) AS retired, coalesce(lag(promo_type) OVER w = 'Special', false) AND NOT coalesce(c_before - lag(c_incl) OVER w >= 2, false) AS prev_on, lag(price) OVER w AS prev_price
  FROM o1 WINDOW w AS (PARTITION BY store_id, sku ORDER BY run_no, seq)),
o3 AS (SELECT *, sum(CASE WHEN on_ AND prev_on THEN 0 ELSE 1 END) OVER (PARTITION BY store_id, sku ORDER BY run_no, seq) AS island,
  CASE WHEN NOT on_ OR was_price IS NOT NULL THEN was_price WHEN NOT prev_on AND prev_price > price THEN prev_price END AS seed FROM o2),
o4 AS (SELECT *, CASE WHEN on_ THEN last_value(seed IGNORE NULLS) OVER (PARTITION BY store_id, sku, island ORDER BY run_no, seq) ELSE was_price END AS was FROM o3),
st AS (SELECT *, row_number() OVER w = 1 OR (price IS DISTINCT FROM lag(price) OVER w OR promo_type IS DISTINCT FROM CASE WHEN retired THEN 'None' ELSE lag(promo_type) OVER w END
  OR was IS DISTINCT FROM CASE WHEN NOT retired THEN lag(was) OVER w END OR unit_price IS DISTINCT FROM lag(unit_price) OVER w OR member_price IS DISTINCT FROM CASE WHEN NOT retired THEN lag(member_price) OVER w END) AS changed
  FROM o4 WINDOW w AS (PARTITION BY store_id, sku ORDER BY run_no, seq))"""


@query(f"WITH {STATE} SELECT store_id, sku, run_id, seq, CAST(price AS DOUBLE) AS price, promo_type, CAST(was AS DOUBLE) AS was_price, changed FROM st")
def g1_reconstruct_was_price(t):
    return ingest.reconstruct_was_price(t.observations, t.runs).select("store_id", "sku", "run_id", "seq", "price", "promo_type", "was_price", "changed")


@query(f"WITH {STATE} SELECT store_id, sku, run_id, seq, CAST(price AS DOUBLE) AS price, promo_type, CAST(was AS DOUBLE) AS was_price, changed FROM st")
def g1_reconstruct_was_price_in_ranges(t):
    out = ingest.reconstruct_was_price(t.observations, t.runs, _keep(t))
    return out.select("store_id", "sku", "run_id", "seq", "price", "promo_type", "was_price", "changed")


@query(f"WITH {STATE} SELECT store_id, sku, run_id, seq, captured_at, CAST(price AS DOUBLE) AS price, promo_type, CAST(was AS DOUBLE) AS was_price, CAST(unit_price AS DOUBLE) AS unit_price, CAST(member_price AS DOUBLE) AS member_price, on_ AS is_on_special, 'NZD' AS currency FROM st WHERE changed")
def g2_price_snapshots(t):
    return ingest.price_snapshots(t.observations, t.runs).drop("multibuy_quantity", "multibuy_total")


LAST = f"""{STATE}, cur AS (SELECT store_id, sku, arg_max(struct_pack(p := price, k := promo_type, w := was, u := unit_price, m := member_price, c := c_incl), (run_no, seq)) AS l, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at,
  max(captured_at) FILTER (WHERE changed) AS price_updated_at FROM st GROUP BY store_id, sku)"""


@query(f"WITH {LAST} SELECT store_id, sku, CAST(l.p AS DOUBLE) AS price, l.k AS promo_type, CAST(l.w AS DOUBLE) AS was_price, first_seen_at, last_seen_at, price_updated_at FROM cur")
def g3_current_listings(t):
    return ingest.current_listings(t.observations, t.runs).select("store_id", "sku", "price", "promo_type", "was_price", "first_seen_at", "last_seen_at", "price_updated_at")


@query(
    f"""WITH {LAST}, tot AS (SELECT store_id, max(c_incl) AS c_total FROM rn GROUP BY store_id), a AS (SELECT cur.*, CAST(c_total - l.c AS BIGINT) AS misses, (SELECT min(started_at) FROM rn WHERE rn.store_id = cur.store_id AND rn.complete AND rn.c_incl = cur.l.c + 1) AS missing_since
  FROM cur JOIN tot ON cur.store_id = tot.store_id)
SELECT store_id, sku, misses, missing_since, misses < 2 AS is_available, CAST(l.p AS DOUBLE) AS price, CASE WHEN misses < 2 THEN l.k ELSE 'None' END AS promo_type, CASE WHEN misses < 2 THEN CAST(l.w AS DOUBLE) END AS was_price FROM a"""
)
def g4_availability(t):
    return ingest.availability(t.observations, t.runs).select("store_id", "sku", "misses", "missing_since", "is_available", "price", "promo_type", "was_price")


def _scraped(t):
    """Observations with paths and tags of their part."""
    o = t.observations.withColumn("k", (F.col("seq") % F.lit(40)).cast("long"))
    node = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), id_.alias("external_id"), id_.alias("slug"), F.concat(id_, F.lit("-"), F.col("seq").cast("string")).alias("name"))
    dep, aisle = F.concat(F.lit("d"), (F.col("k") % 4).cast("string")), F.concat(F.lit("a"), (F.col("k") % 8).cast("string"))
    tag = F.struct(F.lit("Primary").alias("source"), F.concat(F.lit("t"), (F.col("k") % 5).cast("string")).alias("code"), F.concat(F.lit("l"), F.col("seq").cast("string")).alias("label"))
    return o.withColumns({"category_path": F.array(node("Department", dep), node("Aisle", aisle)), "tags": F.array(tag)})


@query(
    """WITH rn AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at, run_id) AS run_no FROM {runs} WHERE status IS NULL),
o AS (SELECT o.*, run_no, seq % 40 AS k FROM {observations} o JOIN rn ON o.run_id = rn.run_id),
n AS (SELECT store_id, 'Department' AS kind, concat('d', k % 4) AS external_id, CAST(NULL AS STRING) AS parent, run_no, seq FROM o UNION ALL SELECT store_id, 'Aisle', concat('a', k % 8), concat('d', k % 4), run_no, seq FROM o)
SELECT store_id, kind, external_id, arg_min(concat(external_id, '-', seq), (run_no, seq)) AS name, arg_min(parent, (run_no, seq)) AS parent_external_id FROM n GROUP BY 1, 2, 3"""
)
def g6_upsert_store_categories(t):
    rows = _scraped(t).join(ingest.numbered_runs(t.runs).select("run_id", "run_no"), "run_id")
    return ingest.upsert_store_categories(rows).select("store_id", "kind", "external_id", "name", "parent_external_id")


@query(
    """WITH rn AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at, run_id) AS run_no FROM {runs} WHERE status IS NULL),
o AS (SELECT o.store_id, sku, run_no, complete, seq % 40 AS k, max(CASE WHEN complete THEN run_no END) OVER (PARTITION BY o.store_id, sku) AS base FROM {observations} o JOIN rn ON o.run_id = rn.run_id)
SELECT DISTINCT store_id, sku, kind, external_id FROM (SELECT store_id, sku, 'Department' AS kind, concat('d', k % 4) AS external_id FROM o WHERE base IS NULL OR run_no >= base
 UNION ALL SELECT store_id, sku, 'Aisle', concat('a', k % 8) FROM o WHERE base IS NULL OR run_no >= base) x"""
)
def g7_product_category_links(t):
    return ingest.product_category_links(_scraped(t), t.runs)


@query(
    """WITH rn AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at, run_id) AS run_no FROM {runs} WHERE status IS NULL)
SELECT s.chain, 'Primary' AS source, concat('t', seq % 40 % 5) AS code, arg_min(concat('l', seq), (started_at, o.run_id, seq)) AS label FROM {observations} o JOIN rn ON o.run_id = rn.run_id JOIN {stores} s ON o.store_id = s.store_id GROUP BY 1, 2, 3"""
)
def g8_sync_tags(t):
    return ingest.sync_tags(_scraped(t), t.runs, t.stores)[0]


@query(
    """WITH rn AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at, run_id) AS run_no FROM {runs} WHERE status IS NULL),
o AS (SELECT o.store_id, sku, run_no, seq % 40 % 5 AS c, max(run_no) OVER (PARTITION BY o.store_id, sku) AS last_ FROM {observations} o JOIN rn ON o.run_id = rn.run_id)
SELECT DISTINCT o.store_id, sku, s.chain, 'Primary' AS source, concat('t', c) AS code FROM o JOIN {stores} s ON o.store_id = s.store_id WHERE run_no = last_"""
)
def g8_tag_links(t):
    return ingest.sync_tags(_scraped(t), t.runs, t.stores)[1]


@query(
    f"""WITH {STATE}, f AS (SELECT run_id, count(*) AS n FROM {{observations}} GROUP BY 1), s AS (SELECT run_id, count(*) AS n FROM st WHERE changed GROUP BY 1)
SELECT r.run_id, CASE WHEN r.status = 'Failed' THEN 0 ELSE coalesce(f.n, 0) END AS products_found, CASE WHEN r.status = 'Failed' THEN 0 ELSE coalesce(s.n, 0) END AS snapshots_written,
 CASE WHEN r.status = 'Failed' THEN 'Failed' WHEN complete THEN 'Succeeded' ELSE 'Partial' END AS status, substr(error_message, 1, 2000) AS error_message FROM {{runs}} r LEFT JOIN f ON r.run_id = f.run_id LEFT JOIN s ON r.run_id = s.run_id"""
)
def g9_close_crawl_runs(t):
    out = ingest.close_crawl_runs(t.observations, ingest.price_snapshots(t.observations, t.runs), t.runs)
    return out.select("run_id", "products_found", "snapshots_written", "status", "error_message")


# ---- categories -------------------------------------------------------------------------------------------------

LIVE = """live AS MATERIALIZED (SELECT * FROM {categories} WHERE NOT is_archived),
closure AS (SELECT category_id AS ancestor_id, category_id FROM live UNION SELECT c.ancestor_id, l.category_id FROM closure c JOIN live l ON l.parent_id = c.category_id)"""
COUNTS = """counts AS MATERIALIZED (SELECT category_id, count(*) AS n FROM (SELECT category_id FROM {items} WHERE category_id IS NOT NULL UNION ALL
  SELECT category_id FROM (SELECT DISTINCT l.product_id, c.category_id FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id AND s.is_active JOIN {product_store_categories} k ON l.product_id = k.product_id
   JOIN {store_categories} c ON k.store_category_id = c.store_category_id WHERE l.item_id IS NULL AND l.is_available AND l.current_price IS NOT NULL AND c.category_id IS NOT NULL) x) y GROUP BY category_id)"""


def _chained(t):
    return t.store_categories.join(t.stores.select("store_id", "chain"), "store_id")


@query(
    """WITH sc AS (SELECT c.*, s.chain FROM {store_categories} c JOIN {stores} s ON c.store_id = s.store_id WHERE s.chain IN ('NewWorld', 'PaknSave')),
sl AS (SELECT *, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '-') AS s0 FROM sc),
p AS (SELECT a.kind, concat_ws('/', c.s0, b.s0, a.s0) AS path, concat_ws('/', c.s0, b.s0) AS parent_path FROM sl a LEFT JOIN sl b ON a.parent_id = b.store_category_id LEFT JOIN sl c ON b.parent_id = c.store_category_id)
SELECT path, min(kind) AS kind, nullif(min(parent_path), '') AS parent_id FROM p GROUP BY path""".replace("{{", "\x00").replace("}}", "\x01")
)
def c1_build_category_tree(t):
    return categories.build_category_tree(_chained(t)).select("path", "kind", "parent_id")


ORACLES["c1_build_category_tree"] = ORACLES["c1_build_category_tree"].replace("\x00", "{").replace("\x01", "}")


@query(
    """WITH one AS (SELECT kind, slug, min(category_id) AS id FROM {categories} GROUP BY 1, 2 HAVING count(*) = 1)
SELECT c.store_category_id, CASE WHEN s.chain IN ('NewWorld', 'PaknSave') THEN g.category_id ELSE coalesce(c.category_id, one.id) END AS category_id
FROM {store_categories} c JOIN {stores} s ON c.store_id = s.store_id LEFT JOIN {categories} g ON g.category_id = c.external_id LEFT JOIN one ON one.kind = c.kind AND one.slug = c.slug"""
)
def c2_map_store_categories(t):
    return categories.map_store_categories(_chained(t), t.categories).select("store_category_id", "category_id")


@query(
    """WITH m AS (SELECT c.store_category_id, c.kind, c.category_id, g.name AS new_name FROM {store_categories} c JOIN {categories} g ON c.category_id = g.category_id WHERE NOT g.is_archived),
r AS (SELECT l.item_id, m.category_id, row_number() OVER (PARTITION BY l.item_id ORDER BY CASE WHEN s.chain IN ('NewWorld', 'PaknSave') THEN 0 ELSE 1 END, CASE m.kind WHEN 'Shelf' THEN 0 WHEN 'Aisle' THEN 1 ELSE 2 END, l.product_id, m.store_category_id) AS rn
  FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id JOIN {product_store_categories} k ON l.product_id = k.product_id JOIN m ON k.store_category_id = m.store_category_id WHERE l.item_id IS NOT NULL)
SELECT i.item_id, coalesce(r.category_id, i.category_id) AS category_id FROM {items} i LEFT JOIN r ON i.item_id = r.item_id AND rn = 1"""
)
def c3_assign_item_categories(t):
    listings = t.listings.join(t.stores.select("store_id", "chain"), "store_id")
    return categories.assign_item_categories(t.items, listings, t.product_store_categories, t.store_categories, t.categories).select("item_id", "category_id")


@query(
    "SELECT 'nodes' AS measure, count(*) AS n FROM {categories} UNION ALL SELECT 'mapped', count(*) FROM {store_categories} WHERE category_id IS NOT NULL UNION ALL SELECT 'categorised', count(*) FROM {items} WHERE category_id IS NOT NULL"
)
def c4_category_map_summary(t):
    return categories.category_map_summary(t.categories, t.store_categories, t.items)


@query(f"WITH RECURSIVE {LIVE} SELECT category_id FROM closure WHERE ancestor_id = 'ECONOMY'")
def c5_category_subtree(t):
    return categories.category_subtree(t.categories, "ECONOMY")


@query(f"WITH {COUNTS} SELECT * FROM counts")
def c6_category_counts(t):
    return categories.category_counts(t.items, t.listings, t.product_store_categories, t.store_categories, t.stores)


@query(
    f"""WITH RECURSIVE {LIVE}, {COUNTS}, tot AS (SELECT ancestor_id AS category_id, CAST(sum(n) AS BIGINT) AS total FROM closure JOIN counts ON closure.category_id = counts.category_id GROUP BY 1),
deep AS (SELECT category_id, count(*) - 1 AS depth FROM closure GROUP BY 1)
SELECT c.category_id, c.parent_id, CASE length(c.path) % 4 WHEN 0 THEN 'Shelf' WHEN 1 THEN 'Department' ELSE c.kind END AS kind, c.name, c.path, depth, coalesce(counts.n, 0) AS n, coalesce(tot.total, 0) AS total
FROM live c JOIN deep ON c.category_id = deep.category_id LEFT JOIN counts ON c.category_id = counts.category_id LEFT JOIN tot ON c.category_id = tot.category_id WHERE depth <= 1"""
)
def c7_category_tree(t):
    """Nodes whose kind is not that of their depth stay or go by their depth."""
    counts = categories.category_counts(t.items, t.listings, t.product_store_categories, t.store_categories, t.stores)
    odd = F.length("path") % 4
    tree = t.categories.withColumn("kind", F.when(odd == 0, "Shelf").when(odd == 1, "Department").otherwise(F.col("kind")))
    return categories.category_tree(tree, counts, "Aisle")


@query("SELECT c.category_id, c.kind, c.path, c.name, count(i.item_id) AS products FROM {categories} c LEFT JOIN {items} i ON i.category_id = c.category_id GROUP BY ALL")
def c8_category_counts_view(t):
    return categories.category_counts_view(t.categories, t.items)


# ---- matching ---------------------------------------------------------------------------------------------------

MERGED = """merged AS (WITH RECURSIVE m(item_id, live_id, hops) AS (SELECT item_id, item_id, 0 FROM {items} UNION ALL SELECT m.item_id, i.merged_into_id, hops + 1 FROM m JOIN {items} i ON m.live_id = i.item_id WHERE i.merged_into_id IS NOT NULL AND hops < 32)
  SELECT item_id, arg_max(live_id, hops) AS live_id FROM m GROUP BY item_id)"""


@query(f"WITH {MERGED} SELECT * FROM merged")
def m1_resolve_merges(t):
    return matching.resolve_merges(t.items)


def _open(t):
    """Unlinked listings of active stores with their chain."""
    return catalog.with_store(t.listings.withColumn("item_id", F.lit(None).cast("string")), t.stores)


def _no_items(t):
    return t.spark.createDataFrame([], ", ".join(f"{c} string" for c in ITEM))


TIER1 = """own AS (SELECT l.* FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id WHERE s.is_active AND s.chain IN ('NewWorld', 'PaknSave')),
t1 AS (SELECT sku, concat('foodstuffs:', sku) AS match_key, arg_min(struct_pack(n := raw_name, b := raw_brand, z := raw_size), (-length(raw_name), store_id, product_id)) AS p FROM own GROUP BY sku)"""


@query(f"WITH {TIER1} SELECT match_key, p.n AS name, p.b AS brand, p.z AS size, (SELECT count(*) FROM own WHERE own.sku = t1.sku) AS n_listings FROM t1")
def m2_tier1_items(t):
    items, listings = matching.tier1_items(_open(t), _no_items(t), keep=_keep(t))
    n = listings.where("item_id is not null").groupBy("item_id").agg(F.count("*").alias("n_listings"))
    return items.join(n, "item_id").select("match_key", "name", "brand", "size", "n_listings")


INDEX = f"""{MERGED}, led AS (SELECT live_id FROM merged JOIN {{items}} k ON merged.item_id = k.item_id WHERE k.match_key IS NOT NULL),
ix AS (SELECT item_id, match_key, {NORM_BRAND.format('brand')} AS brand_norm, {NORM_SIZE.format('size')} AS size_norm, {TOKENS.format('name', NORM_BRAND.format('brand'))} AS tokens FROM {{items}} WHERE merged_into_id IS NULL AND (match_key IS NOT NULL OR item_id IN (SELECT live_id FROM led)))"""


@query(f"WITH {INDEX} SELECT item_id, match_key, brand_norm, size_norm, array_to_string(list_sort(tokens), ' ') AS tokens FROM ix WHERE brand_norm IS NOT NULL AND size_norm IS NOT NULL")
def m3_match_index(t):
    return matching.match_index(t.items, keep=_keep(t)).select("item_id", "match_key", "brand_norm", "size_norm", F.array_join(F.array_sort("item_tokens"), " ").alias("tokens"))


@query(
    f"""WITH {MERGED}, a AS (SELECT c.product_id, min(live_id) AS new_item FROM {{candidates}} c JOIN merged ON c.item_id = merged.item_id WHERE c.status = 'Approved' GROUP BY 1)
SELECT l.product_id, coalesce(a.new_item, l.item_id) AS item_id FROM {{listings}} l LEFT JOIN a ON l.product_id = a.product_id"""
)
def m4_apply_approved(t):
    return matching.apply_approved(t.listings, t.candidates, t.items).select("product_id", "item_id")


SCORED = f"""{INDEX}, voc AS (SELECT DISTINCT {NORM_BRAND.format('brand')} AS brand FROM {{items}} WHERE match_key LIKE 'foodstuffs:%' AND merged_into_id IS NULL),
op AS (SELECT product_id, raw_name, raw_brand, raw_size FROM {{listings}} WHERE item_id IS NULL),
ph AS (SELECT product_id, n, array_to_string(w[1:n], ' ') AS phrase FROM (SELECT product_id, regexp_split_to_array(raw_name, ' ') AS w FROM op WHERE raw_brand IS NULL) x, (VALUES (1), (2), (3)) y(n) WHERE len(w) >= n),
gu AS (SELECT product_id, max_by(phrase, n) AS inferred FROM ph JOIN voc ON {NORM_BRAND.format('phrase')} = voc.brand GROUP BY product_id),
li AS (SELECT op.product_id, inferred, {NORM_SIZE.format('raw_size')} AS size_norm, {NORM_BRAND.format('coalesce(raw_brand, inferred)')} AS brand_norm, {TOKENS.format('raw_name', NORM_BRAND.format('coalesce(raw_brand, inferred)'))} AS t FROM op LEFT JOIN gu ON op.product_id = gu.product_id),
sc AS (SELECT li.product_id, ix.item_id, ix.match_key, inferred, CASE WHEN least(len(t), len(tokens)) > 0 THEN len(list_intersect(t, tokens)) / least(len(t), len(tokens))::DOUBLE ELSE 0 END AS score
  FROM li JOIN ix ON li.brand_norm = ix.brand_norm AND li.size_norm = ix.size_norm WHERE NOT EXISTS (SELECT 1 FROM {{candidates}} c WHERE c.product_id = li.product_id AND c.item_id = ix.item_id AND c.status = 'Rejected')),
scored AS (SELECT * FROM sc WHERE score >= 0.3)"""


def _to_score(t):
    return t.listings, matching.match_index(t.items, keep=_keep(t)), matching.brand_vocabulary(t.items, "foodstuffs"), t.candidates


@query(f"WITH {SCORED} SELECT product_id, item_id, score, inferred FROM scored")
def m5_score_candidates(t):
    return matching.score_candidates(*_to_score(t)).select("product_id", "item_id", "score", "inferred")


DECIDED = f"""{SCORED}, d1 AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second, count(*) OVER (PARTITION BY product_id) AS n_scored FROM scored WINDOW w AS (PARTITION BY product_id ORDER BY score DESC, match_key NULLS LAST, item_id)),
decided AS (SELECT *, bool_or(place = 1 AND score >= 0.8 AND (second IS NULL OR score - second > 0.001)) OVER (PARTITION BY product_id) AS auto,
  bool_or(place = 1 AND (second IS NULL OR score - second > 0.001)) OVER (PARTITION BY product_id) AS clear FROM d1)"""


@query(f"WITH {DECIDED} SELECT product_id, item_id, place, n_scored, auto FROM decided WHERE place <= 3")
def m6_decide(t):
    return matching.shortlisted(*_to_score(t)).select("product_id", "item_id", "place", "n_scored", "auto")


@query(
    f"""WITH {DECIDED} SELECT product_id, item_id, round_even(score, 3) AS score, concat(CASE WHEN inferred IS NOT NULL THEN concat('brand ''', inferred, ''' inferred from name; ') ELSE '' END, 'brand+size match; name overlap ', printf('%.2f', score),
 CASE WHEN clear THEN '' ELSE printf('; ambiguous (%d candidates)', n_scored) END) AS reason, {NOW} AS created_at FROM decided WHERE place <= 3 AND NOT auto AND NOT EXISTS (SELECT 1 FROM {{candidates}} c WHERE c.product_id = decided.product_id AND c.item_id = decided.item_id)"""
)
def m7_queue_candidates(t):
    return matching.queue_candidates(matching.shortlisted(*_to_score(t)), t.candidates, CLOCK).select("product_id", "item_id", "score", "reason", "created_at")


ACTIVE = """act AS (SELECT l.*, s.chain FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id WHERE s.is_active)"""
SHORT = f"(SELECT DISTINCT {NORM_BRAND.format('p_brand')} AS brand FROM {{part}} WHERE p_partkey % 10 < 2 AND p_brand LIKE '%1%')"


def _short(t):
    """A vocabulary that lacks some brands."""
    return t.part.where("p_partkey % 10 < 2 and p_brand like '%1%'").select(text.normalize_brand(F.col("p_brand")).alias("brand")).distinct()


@query(
    f"""WITH {ACTIVE}, own AS (SELECT * FROM act WHERE chain = 'Woolworths' AND {NORM_BRAND.format('raw_brand')} NOT IN (SELECT brand FROM {SHORT} v))
SELECT concat('woolworths:', sku) AS match_key, arg_min(raw_name, (store_id, product_id)) AS name, arg_min(raw_brand, (store_id, product_id)) AS brand, count(*) AS n_listings FROM own GROUP BY 1"""
)
def m8_tier3_anchors(t):
    items, listings = matching.tier3_anchors(_open(t), _no_items(t), _short(t), _keep(t))
    n = listings.where("item_id is not null").groupBy("item_id").agg(F.count("*").alias("n_listings"))
    return items.join(n, "item_id").select("match_key", "name", "brand", "n_listings")


LEADS = f"""ld AS (SELECT DISTINCT product_id FROM (SELECT product_id, array_to_string(w[1:n], ' ') AS phrase FROM (SELECT product_id, regexp_split_to_array(raw_name, ' ') AS w FROM act WHERE chain = 'FreshChoice') x, (VALUES (1), (2), (3)) y(n) WHERE len(w) >= n) p
  JOIN {SHORT} v ON {NORM_BRAND.format('phrase')} = v.brand)"""


@query(
    f"""WITH {ACTIVE}, {LEADS}, own AS (SELECT act.product_id, act.item_id FROM act JOIN {{items}} i ON act.item_id = i.item_id WHERE act.chain = 'FreshChoice' AND i.match_key LIKE 'freshchoice:%')
SELECT own.product_id, own.item_id FROM own JOIN ld ON own.product_id = ld.product_id"""
)
def m9_reclaim_singletons(t):
    return matching.reclaim_singletons(catalog.with_store(t.listings, t.stores), t.items, t.candidates, _short(t))[3]


@query(
    f"""WITH {DECIDED.replace("op AS (SELECT product_id, raw_name, raw_brand, raw_size FROM {listings} WHERE item_id IS NULL)", "op AS (SELECT product_id, raw_name, CAST(NULL AS VARCHAR) AS raw_brand, raw_size FROM {listings} l JOIN {stores} s ON l.store_id = s.store_id WHERE item_id IS NULL AND s.chain = 'FreshChoice')").replace("merged_into_id IS NULL AND (match_key IS NOT NULL OR item_id IN (SELECT live_id FROM led)))", "merged_into_id IS NULL AND match_key LIKE 'woolworths:%')").replace("LIKE 'foodstuffs:%'", "LIKE 'woolworths:%'")}
SELECT product_id, item_id AS linked_to FROM decided WHERE auto AND place = 1"""
)
def m10_tier3b_attach(t):
    rows = t.listings.join(t.stores.where("chain = 'FreshChoice'").select("store_id"), "store_id", "left_semi")
    decided = matching.shortlisted(rows, matching.match_index(t.items, "woolworths"), matching.brand_vocabulary(t.items, "woolworths"), t.candidates, by_name=True)
    return decided.where("auto and place = 1").select("product_id", F.col("item_id").alias("linked_to"))


@query(
    f"""WITH {ACTIVE}, {LEADS} SELECT concat('freshchoice:', sku) AS match_key, arg_min(raw_name, (store_id, product_id)) AS name, count(*) AS n_listings FROM act WHERE chain = 'FreshChoice' AND product_id NOT IN (SELECT product_id FROM ld) GROUP BY 1"""
)
def m11_tier4_singletons(t):
    items, listings = matching.tier4_singletons(_open(t), _no_items(t), _short(t), _keep(t))
    n = listings.where("item_id is not null").groupBy("item_id").agg(F.count("*").alias("n_listings"))
    return items.join(n, "item_id").select("match_key", "name", "n_listings")


@query("SELECT c.candidate_id, c.status FROM {candidates} c WHERE c.status <> 'Pending' OR NOT EXISTS (SELECT 1 FROM {listings} l WHERE l.product_id = c.product_id AND l.first_seen_at % 2 = 0)")
def m12_drop_resolved_candidates(t):
    linked = t.listings.withColumn("item_id", F.when(F.unix_timestamp("first_seen_at") % 2 == 0, F.lit("x")))
    return matching.drop_resolved_candidates(t.candidates, linked).select("candidate_id", "status")


def _pass_sql(p, listings, index, brands):
    """CTEs of one scoring pass over unlinked listings: {p}_dec has the shortlists, auto and place."""
    brand = NORM_BRAND.format("coalesce(raw_brand, inferred)")
    return f"""{p}_ph AS (SELECT product_id, n, array_to_string(w[1:n], ' ') AS phrase FROM (SELECT product_id, regexp_split_to_array(raw_name, ' ') AS w FROM {listings} WHERE raw_brand IS NULL) x, (VALUES (1), (2), (3)) y(n) WHERE len(w) >= n),
{p}_gu AS (SELECT product_id, max_by(phrase, n) AS inferred FROM {p}_ph JOIN {brands} v ON {NORM_BRAND.format('phrase')} = v.brand GROUP BY product_id),
{p}_li AS (SELECT o.product_id, {NORM_SIZE.format('raw_size')} AS size_norm, {brand} AS brand_norm, {TOKENS.format('raw_name', brand)} AS t FROM {listings} o LEFT JOIN {p}_gu ON o.product_id = {p}_gu.product_id),
{p}_ix AS (SELECT match_key, {NORM_BRAND.format('brand')} AS brand_norm, {NORM_SIZE.format('size')} AS size_norm, {TOKENS.format('name', NORM_BRAND.format('brand'))} AS tokens FROM {index}),
{p}_sc AS (SELECT li.product_id, ix.match_key, CASE WHEN least(len(t), len(tokens)) > 0 THEN len(list_intersect(t, tokens)) / least(len(t), len(tokens))::DOUBLE ELSE 0 END AS score FROM {p}_li li JOIN {p}_ix ix ON li.brand_norm = ix.brand_norm AND li.size_norm = ix.size_norm),
{p}_d1 AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM {p}_sc WHERE score >= 0.3 WINDOW w AS (PARTITION BY product_id ORDER BY score DESC, match_key)),
{p}_dec AS MATERIALIZED (SELECT *, bool_or(place = 1 AND score >= 0.8 AND (second IS NULL OR score - second > 0.001)) OVER (PARTITION BY product_id) AS auto FROM {p}_d1)"""


_BRANDS = lambda items: f"(SELECT DISTINCT {NORM_BRAND.format('brand')} AS brand FROM {items} WHERE brand IS NOT NULL)"
_MINTED = "arg_min(raw_name, {0}) AS name, arg_min(struct_pack(b := raw_brand), {0}).b AS brand, arg_min(struct_pack(z := raw_size), {0}).z AS size"
#: The tiers one after the other, from no items and no candidates; an item goes by its key.
CASCADE = f"""WITH {ACTIVE},
t1 AS MATERIALIZED (SELECT concat('foodstuffs:', sku) AS match_key, {_MINTED.format('(-length(raw_name), store_id, product_id)')} FROM act WHERE chain IN ('NewWorld', 'PaknSave') GROUP BY sku),
rest2 AS (SELECT product_id, raw_name, raw_brand, raw_size FROM act WHERE chain NOT IN ('NewWorld', 'PaknSave')),
{_pass_sql('p2', 'rest2', 't1', _BRANDS('t1'))},
open3 AS MATERIALIZED (SELECT * FROM act WHERE chain NOT IN ('NewWorld', 'PaknSave') AND product_id NOT IN (SELECT product_id FROM p2_dec WHERE auto)),
own3 AS (SELECT * FROM open3 WHERE chain = 'Woolworths' AND raw_brand IS NOT NULL AND {NORM_BRAND.format('raw_brand')} NOT IN (SELECT brand FROM {_BRANDS('t1')} v)),
t3 AS MATERIALIZED (SELECT concat('woolworths:', sku) AS match_key, {_MINTED.format('(store_id, product_id)')} FROM own3 GROUP BY sku),
rest3 AS (SELECT product_id, raw_name, CAST(NULL AS VARCHAR) AS raw_brand, raw_size FROM open3 WHERE chain = 'FreshChoice'),
{_pass_sql('p3', 'rest3', 't3', _BRANDS('t3'))},
open4 AS (SELECT * FROM open3 WHERE chain = 'FreshChoice' AND product_id NOT IN (SELECT product_id FROM p3_dec WHERE auto)),
lead4 AS (SELECT product_id FROM (SELECT product_id, array_to_string(w[1:n], ' ') AS phrase FROM (SELECT product_id, regexp_split_to_array(raw_name, ' ') AS w FROM open4) x, (VALUES (1), (2), (3)) y(n) WHERE len(w) >= n) z
  WHERE {NORM_BRAND.format('phrase')} IN (SELECT brand FROM {_BRANDS('t1')} v UNION SELECT brand FROM {_BRANDS('t3')} v2)),
own4 AS (SELECT * FROM open4 WHERE product_id NOT IN (SELECT product_id FROM lead4)),
linked AS (SELECT product_id, chain, sku, concat('foodstuffs:', sku) AS match_key FROM act WHERE chain IN ('NewWorld', 'PaknSave')
  UNION ALL SELECT act.product_id, chain, sku, match_key FROM act JOIN (SELECT product_id, match_key FROM p2_dec WHERE auto AND place = 1 UNION ALL SELECT product_id, match_key FROM p3_dec WHERE auto AND place = 1) p ON act.product_id = p.product_id
  UNION ALL SELECT product_id, chain, sku, concat('woolworths:', sku) FROM own3 UNION ALL SELECT product_id, chain, sku, concat('freshchoice:', sku) FROM own4)"""


@query(
    f"""{CASCADE} SELECT 'live_items' AS measure, (SELECT count(*) FROM t1) + (SELECT count(*) FROM t3) + (SELECT count(DISTINCT sku) FROM own4) AS n
UNION ALL SELECT 'auto_linked', count(*) FROM linked WHERE match_key <> concat(CASE chain WHEN 'Woolworths' THEN 'woolworths:' WHEN 'FreshChoice' THEN 'freshchoice:' ELSE '-' END, sku)
UNION ALL SELECT 'pending', count(*) FROM (SELECT product_id FROM p2_dec WHERE place <= 3 AND NOT auto UNION ALL SELECT product_id FROM p3_dec WHERE place <= 3 AND NOT auto) x WHERE product_id NOT IN (SELECT product_id FROM linked)
UNION ALL SELECT 'decided', 0 UNION ALL SELECT 'reclaimed', 0"""
)
def m13_match_run_summary(t):
    return _matched(t)["summary"]


def _matched(t):
    """The whole cascade from nothing, lineage cut in the shared folder."""
    empty = t.spark.createDataFrame([], "candidate_id string, product_id string, item_id string, score double, reason string, status string")
    cats = t.store_categories
    return matching.run_match(_open(t).withColumn("unit_of_measure", F.lit("1kg")), _no_items(t), empty, t.product_store_categories, cats, keep=_keep(t))


@query(f"{CASCADE} SELECT act.product_id, act.chain, linked.match_key FROM act LEFT JOIN linked ON act.product_id = linked.product_id")
def m14_run_match(t):
    out = _matched(t)
    keys = out["items"].select("item_id", "match_key")
    return out["listings"].join(keys, "item_id", "left").select("product_id", "chain", "match_key")


@query(
    f"""WITH {INDEX}, {ACTIVE}, voc AS (SELECT DISTINCT {NORM_BRAND.format('brand')} AS brand FROM {{items}} WHERE match_key LIKE 'foodstuffs:%' AND merged_into_id IS NULL),
op AS (SELECT * FROM act WHERE item_id IS NULL AND CAST(sku AS BIGINT) % 3 = 0 ),
ph AS (SELECT product_id, n, array_to_string(w[1:n], ' ') AS phrase FROM (SELECT product_id, regexp_split_to_array(raw_name, ' ') AS w FROM op WHERE raw_brand IS NULL) x, (VALUES (1), (2), (3)) y(n) WHERE len(w) >= n),
gu AS (SELECT product_id, max_by(phrase, n) AS inferred FROM ph JOIN voc ON {NORM_BRAND.format('phrase')} = voc.brand GROUP BY product_id),
li AS (SELECT op.product_id, op.chain, {NORM_SIZE.format('raw_size')} AS size_norm, {NORM_BRAND.format('coalesce(raw_brand, inferred)')} AS brand_norm FROM op LEFT JOIN gu ON op.product_id = gu.product_id)
SELECT chain, CASE WHEN size_norm IS NULL THEN 'no size' WHEN brand_norm IS NULL THEN 'no brand' WHEN brand_norm NOT IN (SELECT brand_norm FROM ix WHERE brand_norm IS NOT NULL) THEN 'brand unknown'
 WHEN NOT EXISTS (SELECT 1 FROM ix WHERE ix.brand_norm = li.brand_norm AND ix.size_norm = li.size_norm) THEN 'size differs' ELSE 'overlap too small' END AS cause, count(*) AS n FROM li GROUP BY 1, 2"""
)
def t15_zero_candidate_breakdown(t):
    rows = catalog.with_store(t.listings, t.stores)
    known = t.candidates.where("product_id is not null").join(t.listings.where("cast(sku as bigint) % 3 <> 0").select("product_id"), "product_id", "left_semi")
    return matching.zero_candidate_breakdown(rows, t.items, known)


# ---- curation ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH {MERGED}, d AS (SELECT candidate_id, product_id, item_id, status, length(item_id) % 2 = 0 AS approve FROM {{candidates}}),
r AS (SELECT *, CASE WHEN status <> 'Pending' OR (approve AND row_number() OVER (PARTITION BY product_id, approve AND status = 'Pending' ORDER BY candidate_id) > 1) THEN 'conflict' WHEN approve THEN 'approved' ELSE 'rejected' END AS outcome FROM d)
SELECT c.candidate_id, CASE r.outcome WHEN 'approved' THEN 'Approved' WHEN 'rejected' THEN 'Rejected' ELSE c.status END AS status, CASE WHEN r.outcome IN ('approved', 'rejected') THEN {NOW} END AS reviewed_at FROM {{candidates}} c JOIN r ON c.candidate_id = r.candidate_id
WHERE NOT (CASE r.outcome WHEN 'approved' THEN 'Approved' WHEN 'rejected' THEN 'Rejected' ELSE c.status END = 'Pending' AND c.product_id IN (SELECT product_id FROM r WHERE outcome = 'approved'))"""
)
def t10_apply_review_decisions(t):
    d = t.candidates.select("candidate_id", (F.length("item_id") % 2 == 0).alias("approve"))
    candidates = t.candidates.withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    return curation.apply_review_decisions(candidates, t.listings, t.items, d, CLOCK)[0].select("candidate_id", "status", "reviewed_at")


@query(
    """WITH k AS (SELECT product_id, CASE WHEN length(product_id) % 2 = 0 THEN concat('i', CAST(CAST(sku AS BIGINT) + 1 AS STRING)) END AS want FROM {listings} WHERE CAST(sku AS BIGINT) % 5 = 0)
SELECT l.product_id, CASE WHEN k.product_id IS NULL THEN l.item_id WHEN k.want IS NULL THEN NULL WHEN i.item_id IS NOT NULL THEN k.want ELSE l.item_id END AS item_id
FROM {listings} l LEFT JOIN k ON l.product_id = k.product_id LEFT JOIN {items} i ON k.want = i.item_id AND i.merged_into_id IS NULL"""
)
def t11_apply_manual_links(t):
    want = F.when(F.length("product_id") % 2 == 0, F.concat(F.lit("i"), (F.col("sku").cast("long") + 1).cast("string")))
    links = t.listings.where("cast(sku as bigint) % 5 = 0").select("product_id", want.alias("item_id"))
    return curation.apply_manual_links(t.listings, t.candidates, t.items, links)[0].select("product_id", "item_id")


@query(
    f"""WITH {MERGED}, q AS (SELECT item_id AS source_id, concat('i', CAST(CAST(substr(item_id, 2) AS BIGINT) + 4 AS STRING)) AS target_id FROM {{items}} WHERE CAST(substr(item_id, 2) AS BIGINT) % 10 = 1)
SELECT q.source_id, q.target_id, CASE WHEN t.live_id IS NULL THEN 'unknown' WHEN s.live_id <> q.source_id AND s.live_id = t.live_id THEN 'unchanged' WHEN s.live_id <> q.source_id THEN 'merged elsewhere'
 WHEN t.live_id = q.source_id THEN 'cycle' WHEN t.live_id IN (SELECT source_id FROM q) THEN 'conflict' ELSE 'merged' END AS outcome FROM q JOIN merged s ON q.source_id = s.item_id LEFT JOIN merged t ON q.target_id = t.item_id"""
)
def t12_apply_item_merges(t):
    k = F.substring("item_id", 2, 20).cast("long")
    pairs = t.items.where(k % 10 == 1).select(F.col("item_id").alias("source_id"), F.concat(F.lit("i"), (k + 4).cast("string")).alias("target_id"))
    return curation.apply_item_merges(_full_items(t), t.listings, t.candidates, pairs)[3].select("source_id", "target_id", "outcome")


@query(
    """WITH RECURSIVE k AS (SELECT CAST(substr(item_id, 2) AS BIGINT) AS id FROM {items}),
q AS (SELECT k.id, CASE WHEN k.id % 4 < 3 THEN k.id + 1 ELSE k.id - 3 END AS target FROM k),
-- Of four in a row the first three follow one another and the last one would close the circle.
w AS (SELECT id, CASE WHEN target IN (SELECT id FROM k) THEN CASE WHEN id % 4 < 3 THEN 'merged' WHEN id - 3 IN (SELECT id FROM k) THEN 'cycle' END ELSE 'unknown' END AS outcome, target FROM q),
e AS (SELECT id, target FROM w WHERE outcome = 'merged'),
m(id, live, hops) AS (SELECT id, id, 0 FROM k UNION ALL SELECT m.id, e.target, hops + 1 FROM m JOIN e ON m.live = e.id)
SELECT concat('i', w.id) AS source_id, outcome, concat('i', arg_max(live, hops)) AS survivor FROM w JOIN m ON w.id = m.id GROUP BY w.id, outcome"""
)
def t12_merge_chains(t):
    """Requests that follow one another, each fourth one closing a circle: all sources of a chain lead to its end."""
    k = F.substring("item_id", 2, 20).cast("long")
    fresh = _full_items(t).withColumn("merged_into_id", F.lit(None).cast("string"))
    pairs = fresh.select(F.col("item_id").alias("source_id"), F.concat(F.lit("i"), F.when(k % 4 < 3, k + 1).otherwise(k - 3).cast("string")).alias("target_id"), k.alias("request_no"))
    items, _, _, outcomes = curation.apply_item_merges(fresh, t.listings, t.candidates, pairs)
    return outcomes.join(matching.resolve_merges(items).withColumnRenamed("item_id", "source_id"), "source_id").select("source_id", "outcome", F.col("live_id").alias("survivor"))


def _full_items(t):
    have = t.items.columns
    return t.items.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ITEM])


@query("SELECT trim(p_name) AS name, coalesce(nullif(trim(p_type), 'PROMO'), p_name) AS description, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN 'Pantry' ELSE 'Uncategorised' END AS category, p_partkey AS k FROM {part}")
def t13_create_manual_items(t):
    q = t.part.select(
        F.col("p_partkey").cast("string").alias("request_id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.nullif(F.col("p_type"), F.lit("PROMO")).alias("description"), F.col("p_brand").alias("brand"),
        F.col("p_partkey").cast("string").alias("size"), F.when(F.col("p_size") % 2 == 0, "Pantry").otherwise(" ").alias("category"),
    )
    return curation.create_manual_items(_no_items(t), q)[0].select("name", "description", "brand", "category", F.col("size").cast("long").alias("k"))


@query(
    f"""WITH RECURSIVE {LIVE}, e AS (SELECT category_id FROM live WHERE kind = 'Aisle' AND length(path) % 2 = 0)
SELECT c.category_id, CASE WHEN c.kind = 'Shelf' THEN concat(c.name, ' new') ELSE c.name END AS name, c.is_archived OR c.category_id IN (SELECT closure.category_id FROM closure JOIN e ON closure.ancestor_id = e.category_id) AS is_archived FROM {{categories}} c
UNION ALL SELECT concat(path, '/extra-shelf'), 'Extra Shelf', false FROM live WHERE kind = 'Aisle' AND length(path) % 2 = 1
UNION ALL SELECT concat(path, '/extra-shelf/inner'), 'Inner', false FROM live WHERE kind = 'Aisle' AND length(path) % 2 = 1"""
)
def t14_apply_category_edits(t):
    live, null = t.categories.where("not is_archived"), F.lit(None).cast("string")
    edit = lambda df, op, category, parent, kind, name: df.select(F.concat(F.lit(op), "category_id").alias("edit_id"), F.lit(op).alias("op"), category.alias("category_id"), parent.alias("parent_id"), kind.alias("kind"), name.alias("name"))
    aisles = live.where("kind = 'Aisle'")
    edits = (
        edit(aisles.where("length(path) % 2 = 0"), "archive", F.col("category_id"), null, null, null)
        .union(edit(aisles.where("length(path) % 2 = 1"), "create", null, F.col("category_id"), F.lit("Shelf"), F.lit(" Extra Shelf ")))
        # A child of a node that the same batch makes.
        .union(edit(aisles.where("length(path) % 2 = 1"), "create", null, F.concat("path", F.lit("/extra-shelf")), F.lit("shelf"), F.lit("Inner")).withColumn("edit_id", F.concat(F.lit("inner"), "edit_id")))
        .union(edit(t.categories.where("kind = 'Shelf'"), "rename", F.col("category_id"), null, null, F.concat("name", F.lit(" new"))))
    )
    return curation.apply_category_edits(t.categories, edits)[0].select("category_id", "name", "is_archived")


# ---- sources ----------------------------------------------------------------------------------------------------

CENTS = "(p_partkey * 37 % 5000 + 50)"


def _parts(t):
    # Payloads are much work and made of few bytes, so rows are dealt before: a small file is one task, whatever its rows.
    part = t.part.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select("*", F.expr(CENTS).alias("cents"), F.expr("'20260719T180000Z'").alias("run"))


@query(
    f"""SELECT p_partkey AS k, concat('P', p_partkey, '-EA') AS sku, p_name AS name, {CENTS} / 100.0::DOUBLE AS price, CASE p_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Special' WHEN 2 THEN 'MemberPrice' ELSE 'Multibuy' END AS promo_type,
 CASE WHEN p_partkey % 4 = 2 THEN ({CENTS} - 10) / 100.0::DOUBLE END AS member_price, CASE WHEN p_partkey % 4 = 3 THEN 3 END AS multibuy_quantity, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS depth, concat('P', p_partkey, '.png') AS image FROM {{part}}"""
)
def p1_parse_foodstuffs(t):
    promo = F.struct(
        F.when(F.col("p_partkey") % 4 == 2, F.col("cents") - 10).otherwise(F.col("cents")).alias("rewardValue"), F.lit("3000").alias("decal"), F.lit("NEW_PRICE").alias("rewardType"),
        F.when(F.col("p_partkey") % 4 == 3, 3).otherwise(1).alias("threshold"), (F.col("p_partkey") % 4 == 2).alias("cardDependencyFlag"), F.lit(True).alias("bestPromotion"),
    )
    tree = F.struct(F.when(F.col("p_partkey") % 3 == 0, "Pets").otherwise("Frozen").alias("level0"), F.col("p_type").alias("level1"), F.lit(" ").alias("level2"))
    product = F.struct(
        F.concat(F.lit("P"), "p_partkey", F.lit("-EA")).alias("productId"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("displayName"),
        F.struct(F.col("cents").alias("price")).alias("singlePrice"), F.when(F.col("p_partkey") % 4 != 0, F.array(promo)).alias("promotions"), F.array(tree).alias("categoryTrees"),
    )
    raw = _parts(t).select(F.col("p_partkey").alias("k"), F.to_json(F.struct(F.array(product).alias("products"))).alias("payload"))
    out = parse_foodstuffs(raw)
    return out.select("k", "sku", "name", "price", "promo_type", "member_price", "multibuy_quantity", F.size("category_path").alias("depth"), F.substring_index("image_url", "/", -1).alias("image"))


@query(
    f"""SELECT p_partkey AS k, CAST(p_partkey AS STRING) AS sku, CASE WHEN p_partkey % 4 = 1 THEN ({CENTS} + 100) / 100.0::DOUBLE ELSE {CENTS} / 100.0::DOUBLE END AS price, CASE p_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'MemberPrice' WHEN 2 THEN 'Special' ELSE 'Multibuy' END AS promo_type,
 CASE WHEN p_partkey % 4 = 2 THEN ({CENTS} + 100) / 100.0::DOUBLE END AS was, CASE WHEN p_partkey % 4 = 1 THEN {CENTS} / 100.0::DOUBLE END AS member_price, CASE WHEN p_partkey % 4 = 3 THEN 2 END AS multibuy_quantity, p_type AS department, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n_tags FROM {{part}} WHERE p_partkey % 7 <> 0"""
)
def p5_parse_woolworths(t):
    money = lambda c: (c / 100).cast("decimal(10,2)")
    m = F.col("p_partkey") % 4
    item = F.struct(
        F.when(F.col("p_partkey") % 7 == 0, "PromoTile").otherwise("product").alias("type"), F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.struct(money(F.when(m == 3, F.col("cents")).otherwise(F.col("cents") + F.when(m == 0, 0).otherwise(100))).alias("originalPrice"), money(F.col("cents")).alias("salePrice"), (m.isin(1, 2)).alias("isSpecial"), (m == 1).alias("isClubPrice")).alias("price"),
        F.struct(F.lit("500g").alias("volumeSize"), F.lit(1.5).alias("cupPrice"), F.lit("100g").alias("cupMeasure")).alias("size"),
        F.struct(F.when(m == 0, "Other").otherwise("IsSpecial").alias("tagType"), F.when(m == 3, F.struct(F.lit(2).alias("quantity"), money(F.col("cents") * 2).alias("value"))).alias("multiBuy")).alias("productTag"),
    )
    crumb = F.struct(F.struct(F.lit(3).alias("value"), F.col("p_type").alias("name")).alias("department"))
    raw = _parts(t).select(F.col("p_partkey").alias("k"), F.lit("dep__aisle").alias("scope"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("products"), crumb.alias("breadcrumb"))).alias("payload"))
    out = parse_woolworths(raw)
    return out.select("k", "sku", "price", "promo_type", F.col("non_special_price").alias("was"), "member_price", "multibuy_quantity", F.get("category_path", F.lit(0))["name"].alias("department"), F.size("tags").alias("n_tags"))


@query(
    f"""SELECT p_partkey AS k, concat('x', p_partkey) AS sku, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, 'g') ELSE NULL END AS size, {CENTS} / 100.0::DOUBLE AS price, CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Special' ELSE 'Multibuy' END AS promo_type,
 CASE WHEN p_partkey % 3 = 1 THEN ({CENTS} + 100) / 100.0::DOUBLE END AS was, CASE WHEN p_partkey % 3 = 2 THEN 3 END AS multibuy_quantity, {CENTS} / 100.0::DOUBLE AS unit_price, '1kg' AS uom FROM {{part}}"""
)
def p9_parse_freshchoice(t):
    price = F.format_string("$%.2f", F.col("cents") / 100)
    m = F.col("p_partkey") % 3
    html = F.concat(
        F.lit("<html><body><div class='grid'><div class='talker"), F.when(m == 1, " talker--Special").otherwise(""), F.lit("' id='line_x"), F.col("p_partkey"), F.lit("'><a href='/lines/x'><img src='i.png'></a><span class='talker__product-name'> "), "p_name",
        F.lit(" </span><span class='talker__name__size'>"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_size", F.lit("g"))).otherwise(""), F.lit("</span>"),
        F.when(m == 1, F.concat(F.lit("<span class='talker__prices__was'>was "), F.format_string("$%.2f", (F.col("cents") + 100) / 100), F.lit("</span>"))).otherwise(""),
        F.when(m == 2, "<span class='talker__additional_unit_prices__unit_price--multibuy'>3 for $20.00</span>").otherwise(""),
        F.lit("<strong class='price__sell'>"), price, F.lit("</strong><span class='price__units'> per kg</span></div></div><div class='talker talker--placeholder' id='line_p'></div></body></html>"),
    )
    raw = _parts(t).select(F.col("p_partkey").alias("k"), F.lit("meat").alias("scope"), html.alias("payload"))
    return parse_freshchoice(raw).select("k", "sku", "name", "size", "price", "promo_type", F.col("non_special_price").alias("was"), "multibuy_quantity", "unit_price", F.col("unit_of_measure").alias("uom"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN concat(p_size, 'pk') END AS size FROM {part}")
def p12_pack_size_from_name(t):
    name = F.concat("p_name", F.lit(" Grade 6 "), "p_size", F.when(F.col("p_size") % 2 == 0, " Pack").otherwise("packets"))
    return t.part.select(F.col("p_partkey").alias("k"), text.pack_size_from_name(name).alias("size"))


@query(
    """SELECT 'NewWorld' AS chain, 1784484000 + s_suppkey AS run_ts, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS n_gaps, s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AS complete FROM {supplier}"""
)
def p13_crawl_coverage(t):
    s = t.supplier.select("s_suppkey", F.timestamp_seconds(F.lit(1784484000) + F.col("s_suppkey")).alias("run_ts"))
    pages = s.select("s_suppkey", "run_ts", F.explode(F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))).alias("page"))
    frozen = pages.select("run_ts", F.lit("frozen").alias("scope"), "page", F.lit('{"totalPages": 3, "totalHits": 120, "products": []}').alias("payload"))
    deli = s.where("s_suppkey % 5 = 0").select("run_ts", F.lit("deli").alias("scope"), F.lit(0).alias("page"), F.lit('{"totalPages": 1, "totalHits": 1000, "products": []}').alias("payload"))
    out = crawl_coverage(frozen.union(deli).withColumn("chain", F.lit("NewWorld")))
    return out.select("chain", "run_ts", F.size("gaps").alias("n_gaps"), "complete")


@query("SELECT 'NewWorld' AS chain, 1784484000 AS run_ts, concat('scope', p_partkey) AS scope, p_partkey % 9 AS page FROM {part}")
def s2_read_raw_archive_paths(t):
    path = F.concat(F.lit("file:/raw/NewWorld/20260719T180000Z/scope"), "p_partkey", F.lit("_p"), F.col("p_partkey") % 9, F.lit(".json"))
    return t.part.select(*from_path(path)).drop("format")


@query("SELECT run_id FROM {runs} WHERE started_at >= (SELECT max(started_at) FROM {runs}) - 7 * 86400")
def s3_retained_runs(t):
    last = t.runs.agg(F.max(F.unix_timestamp("started_at"))).first()[0]
    return retained_runs(t.runs.withColumn("run_ts", F.col("started_at")), datetime.fromtimestamp(last, UTC)).select("run_id")


@query("SELECT product_id, CAST(current_price AS DOUBLE) AS current_price, CAST(unit_price AS DOUBLE) AS unit_price, is_available, last_seen_at FROM {listings}")
def s1_tables_round_trip(t):
    root = f"{scratch_root(t.spark)}/tables-{uuid.uuid4().hex}"
    write_table(t.listings, root, "listings")
    return read_table(t.spark, root, "listings").select("product_id", "current_price", "unit_price", "is_available", "last_seen_at")


@query(None)
def g5_apply_crawl_run(t):
    """The last run of each store, of all stores at once, applied to the replay of those before it: equals the replay of all."""
    state, new, rows = _last_runs(t)
    state = ingest.availability(t.observations, state).select(*ingest.STATE)
    return ingest.apply_runs(state, rows, new)[0].select("store_id", "sku", "misses", "missing_since", "is_available", "price", "promo_type", "was_price")


def _last_runs(t):
    """(runs before the last two of each store, these, their observations)."""
    from pyspark.sql import Window as W

    runs = t.runs.where("status is null")
    new = runs.withColumn("rn", F.row_number().over(W.partitionBy("store_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc()))).where("rn <= 2").drop("rn")
    return runs.join(new.select("run_id"), "run_id", "left_anti"), new, _scraped(t).join(new.select("run_id"), "run_id", "left_semi")


@query(None)
def g7_merge_category_links(t):
    """Links of the earlier runs, merged with those of the last two of each store: equals the replay of all."""
    earlier, new, rows = _last_runs(t)
    return ingest.merge_category_links(ingest.product_category_links(_scraped(t), earlier), rows, new)


@query(None)
def g8_merge_tag_links(t):
    earlier, new, rows = _last_runs(t)
    return ingest.merge_tags(*ingest.sync_tags(_scraped(t), earlier, t.stores, times=True), rows, new, t.stores)[1]


@query(None)
def g8_merge_tags(t):
    earlier, new, rows = _last_runs(t)
    return ingest.merge_tags(*ingest.sync_tags(_scraped(t), earlier, t.stores, times=True), rows, new, t.stores)[0].select("chain", "source", "code", "label")


@query(
    "SELECT product_id, CAST(CASE WHEN store_id IN ('1', '2') THEN current_price + 1 ELSE current_price END AS DOUBLE) AS current_price FROM {listings}"
)
def s1_replace_parts(t):
    """All stores' listings, then those of two stores again under the next version."""
    root = f"{scratch_root(t.spark)}/versions-{uuid.uuid4().hex}"
    replace_parts(t.spark, root, "listings", conform(t.listings, "listings"))
    raised = t.listings.where("store_id in ('1', '2')").withColumn("current_price", (F.col("current_price") + 1).cast("decimal(10,2)"))
    replace_parts(t.spark, root, "listings", conform(raised, "listings"))
    return read_parts(t.spark, root, "listings", SCHEMAS["listings"]).select("product_id", "current_price")


for _merged, _replayed in (("g7_merge_category_links", "g7_product_category_links"), ("g8_merge_tag_links", "g8_tag_links"), ("g8_merge_tags", "g8_sync_tags")):
    ORACLES[_merged] = ORACLES[_replayed]
ORACLES["g5_apply_crawl_run"] = ORACLES["g4_availability"]

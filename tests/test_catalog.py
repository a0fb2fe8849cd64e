"""Search by postings against the plain filter, pages by ranges against one sort."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricelake.operators import catalog
from pricelake.sources.tables import scratch_keep

STORES = "store_id string, chain string, name string, suburb string, is_active boolean"
LISTINGS = "product_id string, store_id string, raw_name string, raw_brand string, current_price decimal(10,2), is_available boolean"


def test_needles():
    assert catalog.needle_grams("Milk_2L%x") == ["ilk", "mil"]
    assert catalog.needle_grams("a\\%b\\_c") == ["%b_", "a%b", "b_c"]
    assert catalog.needle_grams("crème") == [] and catalog.needle_grams("ab") == [] and catalog.needle_grams("") == []


def test_search_equals_the_plain_filter(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB_% é") for _ in range(rng.randrange(1, 9)))
    rows = [(f"p{i}", "s1", rng.choice([word(), word() + word(), "", None]), rng.choice([None, "", word()]), "1.00", True) for i in range(300)]
    rows += [("k", "s1", "MIKL", None, "1.00", True), ("o", "s1", "ΟΔΟΣ ΟΔΟΣΑ", None, "1.00", True)]
    listings = spark.createDataFrame(rows, LISTINGS.replace("decimal(10,2)", "string")).withColumn("current_price", F.col("current_price").cast("decimal(10,2)"))
    stores = spark.createDataFrame([("s1", "c", "n", "b", True)], STORES)
    postings = catalog.write_postings(listings, scratch_keep(spark))
    pruned = 0
    for q in [*(word().strip() for _ in range(10)), "aba", "AB_b", "a%bab", "bab\\_", "mikl", "οδος", " aab ", "", "%"]:
        if q.endswith("\\"):
            continue
        ids = lambda df: sorted(r.product_id for r in df.select("product_id").collect())
        assert ids(catalog.search_listings(listings, stores, postings, q)) == ids(catalog.find_listings(listings, stores, q)), q
        pruned += bool(catalog.needle_grams(q.strip()))
    assert pruned > 4
    assert catalog.search_listings(listings.limit(0), stores, postings.limit(0), "abab").count() == 0


def written(tmp_path, spark):
    def write(df, name, by):
        df.write.partitionBy(*by).parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return write


@pytest.mark.parametrize("ranges", [1, 7])
def test_pages_by_ranges_equal_one_sort(spark, tmp_path, ranges):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k", "1 AS place_")
    order = [F.col("k").desc(), F.col("id")]
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    index = catalog.PageIndex(df, order, written(tmp_path, spark), ranges)
    assert index.figures(2, 30) == (1000, 34, True) and index.figures(34, 30)[2] is False
    for n in (1, 2, 17, 34, 35):
        got = index.page(n, 30).collect()
        assert [r.id for r in got] == want[30 * (n - 1) : 30 * n] and [r.place for r in got] == [*range(30 * n - 29, 30 * n - 29 + len(got))]
    assert [r.id for r in index.page(0, 1000).collect()] == want[:100]


def test_the_last_page_reads_its_own_range_only(spark, tmp_path):
    index = catalog.PageIndex(spark.range(1000).toDF("id"), [F.col("id")], written(tmp_path, spark), 8)
    folders = sorted(Path(tmp_path).glob("pages-*/range_=*"), key=lambda p: int(p.name.split("=")[1]))
    assert len(folders) == 8
    for p in folders[:-1]:
        shutil.rmtree(p)
    assert [r.id for r in index.page(50, 20).collect()] == [*range(980, 1000)]


def test_pages_of_an_empty_table(spark, tmp_path):
    index = catalog.PageIndex(spark.range(0).toDF("id"), [F.col("id")], scratch_keep(spark))
    assert index.figures() == (0, 0, False) and index.page().count() == 0


def test_postings_do_not_grow_with_listings_of_the_same_texts(spark):
    rows = [(f"p{i}", "s1", "Oat milk", None if i % 2 else "Harbour", None, True) for i in range(50)]
    listings = spark.createDataFrame(rows, LISTINGS.replace("decimal(10,2)", "string")).withColumn("current_price", F.lit(1).cast("decimal(10,2)"))
    stores = spark.createDataFrame([("s1", "c", "n", "b", True)], STORES)
    postings = catalog.write_postings(listings, scratch_keep(spark))
    assert postings.count() == len("Oat milk") - 2 + len("Harbour") - 2
    # Listings that share an id stay apart, and one found by name and brand comes once.
    again = listings.union(listings)
    assert catalog.search_listings(again, stores, postings, "arb").count() == 50
    assert catalog.search_listings(again, stores, postings, "milk").count() == 100

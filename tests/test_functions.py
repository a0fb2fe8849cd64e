"""Scalar rules, case by case."""

from pyspark.sql import functions as F

from pricelake.functions import pricing, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_brand(spark):
    assert column(spark, ["Kowhai", "  Rata  ", "TUI'nVALE", None, "   "], text.normalize_brand) == ["kowhai", "rata", "tui nvale", None, None]


def test_size(spark):
    got = column(spark, ["250g", "1 kg", "4 x 100ml", "kg", "ea", None, "12 Pack", "12pk", "6packs", "10pkt"], text.normalize_size)
    assert got == ["250g", "1kg", "4x100ml", None, None, None, "12pk", "12pk", "6pk", "10pk"]


def test_tokens_and_overlap(spark):
    rows = [("kowhai biscuits oat", "kowhai"), ("Rata Wild Plum 3L", "Rata"), ("Crunchy & Golden Oat Biscuits", None), (None, None)]
    df = spark.createDataFrame(rows, "n string, b string").select(F.array_sort(text.tokenize(F.col("n"), F.col("b"))).alias("t"))
    assert [r.t for r in df.collect()] == [["biscuits", "oat"], ["plum", "wild"], ["biscuits", "crunchy", "golden", "oat"], []]
    pairs = spark.createDataFrame([(["cheese", "colby"], ["cheese", "colby", "creamy"]), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in pairs.select(text.token_overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_unit_price(spark):
    rows = [("31.20", "1kg"), ("7.15", "100g"), ("5.00", "10g"), ("2.50", "1L"), ("0.30", "100mL"), ("0.85", "ea"), ("1", ""), ("1", "100"), ("1", "pack"), (None, "1kg"), ("1", "0g"), ("1", None)]
    df = spark.createDataFrame(rows, "p string, u string")
    u = pricing.comparable_unit_price(F.col("p").cast("decimal(12,4)"), F.col("u"))
    got = [(float(r[0]["price"]), r[0]["unit"]) if r[0] else None for r in df.select(u).collect()]
    assert got == [(31.2, "1kg"), (71.5, "1kg"), (500, "1kg"), (2.5, "1L"), (3.0, "1L"), (0.85, "1ea"), None, None, None, None, None, None]


def test_slugs(spark):
    assert column(spark, ["  Jams, Honey & Spreads ", "Rosé's", None], text.slugify) == ["jams-honey-spreads", "rosé-s", None]
    assert column(spark, ["Miller's Corner", "Pets’ Treats"], text.source_slugify) == ["millers-corner", "pets-treats"]


def test_infer_brand(spark):
    names = [("1", "Rata Farms Barley Rolled"), ("2", "Holt & Daughters Plum Chutney"), ("3", "Loose Kumara"), ("4", None), ("5", "Rata"), ("6", "")]
    listings = spark.createDataFrame(names, "product_id string, raw_name string")
    brands = spark.createDataFrame([("rata farms",), ("rata",), ("holt daughters",)], "brand string")
    assert {r.product_id: r.inferred for r in text.infer_brand(listings, brands).collect()} == {"1": "Rata Farms", "2": "Holt & Daughters", "5": "Rata"}


def test_pack_size(spark):
    names = ["Rolls Grade 4 18 Pack", "Buns Size 9 18pk", "Muffins Mini 9pack", "Tray 24 Pack", "Jam"]
    assert column(spark, names, text.pack_size_from_name) == ["18pk", "18pk", "9pk", "24pk", None]

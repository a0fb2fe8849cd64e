"""Parsers, archive paths and coverage."""

import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from pricelake.sources import archive
from pricelake.sources.archive import read_raw_archive, retained_runs
from pricelake.sources.coverage import crawl_coverage
from pricelake.sources.parsers import parse_foodstuffs, parse_freshchoice, parse_woolworths

PAGE = """<html><body><nav><a href="/q?page=5" rel="next prefetch">more</a></nav><section>
<div id="line_q7" class="talker talker--Discount talker--Special"><strong class="price__sell">$7.25</strong><span class="talker__prices__was">was $9.75</span>
<span class="talker__name__size">340g</span><span class="talker__product-name">Harbour Oat Crackers</span><span class="talker__prices__comparison--UnitPrice">$2.13 per 100g</span>
<span class="talker__sticker__label">you  save
$2.50</span><div class="talker__section--image"><a href="/lines/oat-crackers"><img src="crackers.webp"></a></div></div>
<div id="line_q8" class="talker talker--Deal"><span class="talker__product-name">Dozen Duck Eggs 18 Pack</span><span class="talker__sticker__label">2 for $31</span><strong class="price__sell">$16.40</strong></div>
<div id="line_q9" class="talker"><strong class="price__sell">$61.50</strong><span class="price__units">per kg</span><span class="talker__product-name">Smoked Eel</span></div>
<div id="line_r1" class="talker"><span class="talker__product-name">Sold out jam</span></div><div id="line_r2" class="talker talker--placeholder"></div></section></body></html>"""


def test_freshchoice(spark):
    raw = spark.createDataFrame([("pantry", PAGE), ("other", "<h1>closed"), ("none", None)], "scope string, payload string")
    got = {r.sku: r for r in parse_freshchoice(raw, "https://market").collect()}
    assert set(got) == {"q7", "q8", "q9"}
    a, b, c = got["q7"], got["q8"], got["q9"]
    assert (float(a.price), float(a.non_special_price), a.promo_type, float(a.unit_price), a.unit_of_measure, a.size, a.url, a.image_url) == (7.25, 9.75, "Special", 2.13, "100g", "340g", "https://market/lines/oat-crackers", "crackers.webp")
    assert [(t.code, t.label) for t in a.tags] == [("Special", "you save $2.50"), ("Discount", "you save $2.50")]
    assert (b.promo_type, b.multibuy_quantity, float(b.multibuy_total), b.size) == ("Multibuy", 2, 31.0, "18pk")
    assert (float(c.unit_price), c.unit_of_measure, c.promo_type, c.tags) == (61.5, "1kg", "None", [])


def test_freshchoice_cards_survive_elements_left_open(spark):
    card = lambda i, inside="": f"<div class='talker' id='line_{i}'>{inside}<span class='talker__product-name'>Jam {i}</span><strong class='price__sell'>$1.{i}0</strong></div>"
    pages = [
        card(1, "<p>an open paragraph") + card(2, "</b></span>") + card(3),
        card(1).removesuffix("</div>") + card(2) + card(3).removesuffix("</div>"),
        "<div><ul><li>" + card(1) + "<li>" + card(2, "<i><b>") + "</ul>" + card(3) + "</section>",
    ]
    got = parse_freshchoice(spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "scope string, payload string")).collect()
    assert sorted((r.scope, r.sku, r.name, float(r.price)) for r in got) == [(str(p), str(i), f"Jam {i}", 1 + i / 10) for p in range(3) for i in (1, 2, 3)]


def test_foodstuffs(spark):
    product = {
        "productId": "7120033-EA-000", "name": "Quinces", "displayName": "kg", "singlePrice": {"price": 1340, "comparativePrice": {"pricePerUnit": 3150, "unitQuantityUom": "1kg"}},
        "promotions": [{"rewardValue": 1, "threshold": 5}, {"rewardValue": 1205, "decal": "4000", "rewardType": "NEW_PRICE", "cardDependencyFlag": True, "bestPromotion": True}],
        "categoryTrees": [{"level0": "Frozen", "level1": "Berries", "level2": ""}, {"level0": "Pets"}, {"level0": "Frozen", "level1": "Pastry"}],
    }
    rows = [json.dumps({"products": [product, {"productId": "x"}, {"productId": "y", "singlePrice": {"price": 100}}]}), "not json", None]
    got = parse_foodstuffs(spark.createDataFrame([(x,) for x in rows], "payload string")).collect()
    own = [r for r in got if r.sku.startswith("71")]
    assert len(got) == 3 and len(own) == 2 and own[0].image_url.endswith("/7120033.png")
    assert (own[0].promo_type, float(own[0].price), float(own[0].member_price), own[0].tags[0].code, float(own[0].unit_price)) == ("MemberPrice", 13.40, 12.05, "4000", 31.50)
    assert sorted(n.name for r in own for n in r.category_path) == ["Berries", "Frozen", "Frozen", "Pastry"]


def test_woolworths(spark):
    item = lambda **x: {"type": "Product", "sku": 1, "price": {"originalPrice": 8.3, "salePrice": 7.15, "isSpecial": True, "isClubPrice": True}, "size": {"cupPrice": 41, "cupListPrice": 47.5}} | x
    items = [item(), item(sku="2", price={"salePrice": 31.2, "originalPrice": 38.6, "isSpecial": True}), item(sku="3", price={"salePrice": 9}, productTag={"tagType": "Other", "multiBuy": {"quantity": 3, "value": 20}}), item(type="Tile", sku="4"), item(sku=" ")]
    raw = spark.createDataFrame([("bakery__rolls", json.dumps({"products": {"items": items}, "breadcrumb": {"department": {"value": 12, "name": "Bakery"}}}))], "scope string, payload string")
    got = {r.sku: r for r in parse_woolworths(raw).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].promo_type, float(got["1"].price), float(got["1"].member_price), float(got["1"].unit_price), got["1"].non_special_price) == ("MemberPrice", 8.3, 7.15, 47.5, None)
    assert (got["2"].promo_type, float(got["2"].non_special_price)) == ("Special", 38.6)
    assert (got["3"].promo_type, got["3"].multibuy_quantity, float(got["3"].multibuy_total), got["3"].tags) == ("Multibuy", 3, 20.0, [])
    assert [(n.external_id, n.name) for n in got["1"].category_path] == [("12", "Bakery"), ("rolls", "rolls")]


def test_archive_and_coverage(spark, tmp_path):
    pages = {"NewWorld/20260719T180000Z/frozen_p0.json": {"totalPages": 2, "totalHits": 60}, "Woolworths/20260719T180000Z/fish_p1.json": {"products": {"totalItems": 40}, "dasFacets": [{"group": "Aisle", "name": "Fresh Fish"}]}, "Woolworths/20260701T180000Z/fish_p1.json": {"products": {"totalItems": 40}}}
    for path, body in pages.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(body))
    raw = read_raw_archive(spark, str(tmp_path))
    assert sorted((r.chain, r.scope, r.page) for r in raw.collect()) == [("NewWorld", "frozen", 0), ("Woolworths", "fish", 1), ("Woolworths", "fish", 1)]
    got = {(r.chain, r.run_ts.day): list(r.gaps) for r in crawl_coverage(raw).collect()}
    assert got == {("NewWorld", 19): ["frozen: page 1 missing"], ("Woolworths", 19): ["fish__fresh-fish: not archived"], ("Woolworths", 1): []}
    assert retained_runs(raw, datetime(2026, 7, 20, tzinfo=UTC)).select(F.countDistinct("run_ts")).first()[0] == 1


def test_runs_that_are_not_retained_are_never_opened(spark, tmp_path):
    for run, scope in (("20260101T000000Z", "old"), ("20260110T060000Z", "edge case"), ("20260116T060000Z", "new")):
        folder = tmp_path / "NewWorld" / run
        folder.mkdir(parents=True)
        (folder / f"{scope.replace(' ', '%20')}_p3.json").write_text(f'{{"scope": "{scope}"}}')
    root, now = str(tmp_path), datetime(2026, 1, 17, 6, tzinfo=UTC)
    assert archive.archive_files(spark, root).count() == 3
    df = archive.read_retained(spark, root, now)
    assert not [f for f in df.inputFiles() if "20260101" in f] and len(df.inputFiles()) == 2
    for f in (tmp_path / "NewWorld/20260101T000000Z").iterdir():
        f.unlink()  # whoever opens it now fails
    assert sorted((r.payload, r.page) for r in df.collect()) == [('{"scope": "edge case"}', 3), ('{"scope": "new"}', 3)]
    assert archive.read_retained(spark, root, datetime(2027, 1, 1, tzinfo=UTC)).count() == 0


def test_payloads_of_a_small_file_are_parsed_by_several_tasks(spark):
    from pricelake.plans.derive import Tables
    from pricelake.plans.queries import QUERIES, _parts

    sf = "/root/testdata/sf0.001"
    used = _parts(Tables(spark, sf)).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert QUERIES["p9_parse_freshchoice"](spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_freshchoice_keeps_all_columns_of_pages_with_several_cards(spark):
    card = "<div class='talker' id='line_{0}'><span class='talker__product-name'>n{0}</span><strong class='price__sell'>$1.50</strong></div>"
    rows = [(1, [1.5], card.format("a") + card.format("b") + "<a rel='next' href='/2'>"), (2, None, None), (3, [], card.format("c"))]
    got = parse_freshchoice(spark.createDataFrame([(k, "meat", v, p) for k, v, p in rows], "k long, scope string, v array<double>, payload string")).collect()
    assert sorted((r.k, r.v, r.seq, r.sku, r.name, float(r.price)) for r in got) == [(1, [1.5], 0, "a", "na", 1.5), (1, [1.5], 1, "b", "nb", 1.5), (3, [], 0, "c", "nc", 1.5)]

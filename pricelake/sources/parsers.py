"""Archived payloads to scraped rows, one parser a chain.

A parser takes (payload, ...) rows and gives the columns of ``scraped`` with the row's own columns before
them; seq counts the products of a payload from 0. JSON is read by Spark with fixed schemas: a field of
another type is null, a number where text is asked for is its text. Payloads that are not JSON give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pack_size_from_name, source_slugify

# The departments that Foodstuffs crawls take, and where its images lie.
FOODSTUFFS_DEPARTMENTS = ("Meat, Poultry & Seafood", "Fruit & Vegetables", "Fridge, Deli & Eggs", "Frozen")
FOODSTUFFS_IMAGE = "https://a.fsimg.co.nz/product/retail/fan/image/400x400/"
FOODSTUFFS_SCHEMA = (
    "products array<struct<productId: string, brand: string, name: string, displayName: string, singlePrice: struct<price: int, comparativePrice: struct<pricePerUnit: int, unitQuantityUom: string, measureDescription: string>>, "
    "promotions: array<struct<rewardValue: int, decal: string, rewardType: string, threshold: int, cardDependencyFlag: boolean, bestPromotion: boolean>>, "
    "categoryTrees: array<struct<level0: string, level1: string, level2: string>>>>, totalHits int, totalPages int"
)
NODE = "struct<value: string, name: string>"
WOOLWORTHS_SCHEMA = (
    "products struct<totalItems: int, items: array<struct<type: string, sku: string, name: string, brand: string, barcode: string, images: struct<big: string, small: string>, "
    "price: struct<originalPrice: decimal(10,2), salePrice: decimal(10,2), isSpecial: boolean, isClubPrice: boolean>, "
    "size: struct<volumeSize: string, packageType: string, cupListPrice: decimal(12,4), cupPrice: decimal(12,4), cupMeasure: string>, "
    f"productTag: struct<tagType: string, multiBuy: struct<quantity: decimal(10,2), value: decimal(10,2)>>>>>, breadcrumb struct<department: {NODE}, aisle: {NODE}, shelf: {NODE}>, "
    "dasFacets array<struct<group: string, name: string>>"
)
OUT = ["seq", "sku", "name", "brand", "size", "gtin", "url", "image_url", "price", "non_special_price", "promo_type", "member_price", "multibuy_quantity", "multibuy_total", "unit_price", "unit_of_measure", "category_path", "tags"]


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _node(kind: str, external_id: Column, slug: Column, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), external_id.alias("external_id"), slug.alias("slug"), name.alias("name"))


def _cents(c: Column) -> Column:
    return (c.cast("decimal(12,2)") / 100).cast("decimal(10,2)")


def foodstuffs_promo(promotions: Column, price: Column) -> Column:
    """Struct (promo_type, member_price, multibuy_quantity, multibuy_total, tags) of a product's promotions: the best one, or else the first."""
    best = F.coalesce(F.get(F.filter(promotions, lambda p: F.coalesce(p["bestPromotion"], F.lit(False))), F.lit(0)), F.get(promotions, F.lit(0)))
    card = F.coalesce(best["cardDependencyFlag"], F.lit(False))
    reward = _cents(best["rewardValue"])
    multi = (F.coalesce(best["threshold"], F.lit(1)) > 1) & reward.isNotNull()
    kind = F.when(best.isNull(), "None").when(card, "MemberPrice").when(multi, "Multibuy").otherwise("Special")
    tag = F.struct(F.lit("Primary").alias("source"), best["decal"].alias("code"), best["rewardType"].alias("label"))
    return F.struct(
        kind.alias("promo_type"),
        F.when(card & ~multi & (reward < price), reward).alias("member_price"),
        F.when(multi, best["threshold"]).alias("multibuy_quantity"),
        F.when(multi, reward).alias("multibuy_total"),
        F.when(_blank(best["decal"]), F.array().cast("array<struct<source: string, code: string, label: string>>")).otherwise(F.array(tag)).alias("tags"),
    )


def foodstuffs_image_url(sku: Column) -> Column:
    """The image of the part of the SKU before its first dash."""
    part = F.when(F.locate("-", sku) > 1, F.substring_index(sku, "-", 1)).otherwise(sku)
    return F.concat(F.lit(FOODSTUFFS_IMAGE), part, F.lit(".png"))


def foodstuffs_category_rows(trees: Column, slug) -> Column:
    """Array of paths: one for each tree of a crawled department, or else one empty path."""
    own = F.filter(trees, lambda t: t["level0"].isin(*FOODSTUFFS_DEPARTMENTS))

    def path(t: Column) -> Column:
        nodes = [F.when(~_blank(t[f"level{i}"]), _node(k, t[f"level{i}"], slug(t[f"level{i}"]), t[f"level{i}"])) for i, k in enumerate(("Department", "Aisle", "Shelf"))]
        return F.array_compact(F.array(*nodes))

    paths = F.transform(own, path)
    empty = F.array(F.array().cast("array<struct<kind: string, external_id: string, slug: string, name: string>>"))
    return F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, paths).otherwise(empty)


def parse_foodstuffs(raw: DataFrame) -> DataFrame:
    """Products of Foodstuffs pages, one row for each category tree of a crawled department."""
    own = [c for c in raw.columns if c != "payload"]
    rows = raw.select(*own, F.posexplode(F.from_json("payload", FOODSTUFFS_SCHEMA)["products"]).alias("seq", "p"))
    rows = rows.where(~_blank(F.col("p.productId")) & F.col("p.singlePrice.price").isNotNull()).withColumn("price_", _cents(F.col("p.singlePrice.price")))
    rows = rows.withColumn("promo", foodstuffs_promo(F.col("p.promotions"), F.col("price_")))
    rows = rows.withColumn("category_path", F.explode(foodstuffs_category_rows(F.col("p.categoryTrees"), source_slugify)))
    comp = F.col("p.singlePrice.comparativePrice")
    return rows.select(
        *own, F.col("seq").cast("long").alias("seq"), F.col("p.productId").alias("sku"), F.coalesce("p.name", "p.productId").alias("name"), F.col("p.brand").alias("brand"), F.col("p.displayName").alias("size"),
        _none("string").alias("gtin"), _none("string").alias("url"), foodstuffs_image_url(F.col("p.productId")).alias("image_url"), F.col("price_").alias("price"), _none("decimal(10,2)").alias("non_special_price"),
        "promo.promo_type", "promo.member_price", "promo.multibuy_quantity", "promo.multibuy_total", (comp["pricePerUnit"].cast("decimal(14,2)") / 100).cast("decimal(12,4)").alias("unit_price"),
        F.coalesce(comp["measureDescription"], comp["unitQuantityUom"]).alias("unit_of_measure"), "category_path", "promo.tags",
    )


def woolworths_promo(item: Column) -> Column:
    """Struct (promo_type, price, non_special_price, member_price, unit_price, multibuy_quantity, multibuy_total) of an item."""
    original, sale = item["price"]["originalPrice"], F.coalesce(item["price"]["salePrice"], item["price"]["originalPrice"])
    club, special = F.coalesce(item["price"]["isClubPrice"], F.lit(False)), F.coalesce(item["price"]["isSpecial"], F.lit(False))
    q, value = item["productTag"]["multiBuy"]["quantity"], item["productTag"]["multiBuy"]["value"]
    multi = (F.coalesce(q, F.lit(0)) > 1) & value.isNotNull()
    shelf = club & original.isNotNull()
    return F.struct(
        F.when(club, "MemberPrice").when(special, "Special").when(multi, "Multibuy").otherwise("None").alias("promo_type"),
        F.when(shelf, original).otherwise(sale).alias("price"),
        F.when(~club & special, original).alias("non_special_price"),
        F.when(shelf & (sale < original), sale).alias("member_price"),
        F.when(shelf, F.coalesce(item["size"]["cupListPrice"], item["size"]["cupPrice"])).otherwise(item["size"]["cupPrice"]).alias("unit_price"),
        F.when(multi, F.floor(q).cast("int")).alias("multibuy_quantity"),
        F.when(multi, value).alias("multibuy_total"),
    )


def woolworths_tags(tag: Column) -> Column:
    """The tag's type, unless blank or 'Other'."""
    none = F.array().cast("array<struct<source: string, code: string, label: string>>")
    one = F.array(F.struct(F.lit("Primary").alias("source"), tag.alias("code"), _none("string").alias("label")))
    return F.when(_blank(tag) | (F.lower(tag) == "other"), none).otherwise(one)


def woolworths_path(breadcrumb: Column, scope: Column) -> Column:
    """Nodes of the slugs in the scope's name (``a__b__c``), with ids and names of the breadcrumb where it has them."""
    slugs = F.split(scope, "__")

    def node(i: int, kind: str, key: str) -> Column:
        slug = F.get(slugs, F.lit(i))
        b = breadcrumb[key]
        return F.when(slug.isNotNull() & (slug != ""), _node(kind, F.coalesce(b["value"], slug), slug, F.coalesce(b["name"], slug)))

    return F.array_compact(F.array(node(0, "Department", "department"), node(1, "Aisle", "aisle"), node(2, "Shelf", "shelf")))


def parse_woolworths(raw: DataFrame) -> DataFrame:
    """Products of Woolworths pages (payload, scope, ...)."""
    own = [c for c in raw.columns if c != "payload"]
    rows = raw.withColumn("j", F.from_json("payload", WOOLWORTHS_SCHEMA)).withColumn("category_path", woolworths_path(F.col("j.breadcrumb"), F.col("scope")))
    rows = rows.select(*own, "category_path", F.posexplode("j.products.items").alias("seq", "p"))
    rows = rows.where((F.lower("p.type") == "product") & ~_blank(F.col("p.sku")) & F.coalesce("p.price.salePrice", "p.price.originalPrice").isNotNull())
    rows = rows.withColumn("promo", woolworths_promo(F.col("p")))
    return rows.select(
        *own, F.col("seq").cast("long").alias("seq"), F.col("p.sku").alias("sku"), F.coalesce("p.name", "p.sku").alias("name"), F.col("p.brand").alias("brand"), F.coalesce("p.size.volumeSize", "p.size.packageType").alias("size"),
        F.col("p.barcode").alias("gtin"), _none("string").alias("url"), F.coalesce("p.images.big", "p.images.small").alias("image_url"), "promo.price", "promo.non_special_price", "promo.promo_type", "promo.member_price",
        "promo.multibuy_quantity", "promo.multibuy_total", "promo.unit_price", F.col("p.size.cupMeasure").alias("unit_of_measure"), "category_path", woolworths_tags(F.col("p.productTag.tagType")).alias("tags"),
    )


#: Parts of a product card, by the class that marks their text.
CARD_TEXT = {
    "talker__product-name": "name", "talker__name__size": "size", "price__sell": "sell", "price__units": "units", "talker__prices__was": "was", "talker__prices__comparison--UnitPrice": "comparison",
    "talker__additional_unit_prices__unit_price--multibuy": "multi", "talker__sticker__label": "sticker",
}
#: A part that only one kind of element has.
CARD_TAG = {"sell": "strong", "units": "span"}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
CARD_COLUMNS = ["seq", "sku", "classes", *CARD_TEXT.values(), "href", "image", "next"]


class Cards(HTMLParser):
    """The texts of a page's product cards; what they mean is left to columns.

    Open elements are a stack. An end tag closes the nearest open element of its name with all that is open
    inside, or is ignored where there is none, so elements left open lose nothing. A card that is still open
    where the next one starts, or at the end of the page, counts up to there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.next: str | None = None
        self.open: list[str] = []
        self.card: dict | None = None
        self.card_at = 0
        self.parts: list[tuple[int, str]] = []
        self.image_at: int | None = None

    def flush(self) -> None:
        if self.card is not None:
            self.cards.append(self.card)
        self.card, self.parts, self.image_at = None, [], None

    def shrink(self, size: int) -> None:
        """Close all open elements beyond the first ``size``."""
        del self.open[size:]
        if self.card is not None and self.card_at > size:
            self.flush()
        self.parts = [p for p in self.parts if p[0] <= size]
        if self.image_at is not None and self.image_at > size:
            self.image_at = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and "next" in (a.get("rel") or "").split() and self.next is None:
            self.next = a.get("href")
        starts = tag == "div" and "talker" in classes and (a.get("id") or "").startswith("line_")
        if starts and self.card is not None:
            self.shrink(self.card_at - 1)
        elif tag in ("p", "div", "ul", "table") and self.open and self.open[-1] == "p":
            self.shrink(len(self.open) - 1)  # a paragraph ends where a block starts
        if tag not in VOID:
            self.open.append(tag)
        depth = len(self.open)
        if starts:
            self.card, self.card_at = {"sku": a["id"][5:], "classes": " ".join(classes)}, depth
            return
        if self.card is None:
            return
        for c in classes:
            part = CARD_TEXT.get(c)
            if part and CARD_TAG.get(part, tag) == tag and part not in self.card:
                self.card[part] = ""
                self.parts.append((depth, part))
        if "talker__section--image" in classes:
            self.image_at = depth
        if tag == "a" and (a.get("href") or "").startswith("/lines/"):
            self.card.setdefault("href", a["href"])
        if tag == "img" and self.image_at is not None:
            self.card.setdefault("image", a.get("src"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in VOID and tag in self.open:
            self.shrink(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        for _, part in self.parts:
            self.card[part] += data

    def close(self):
        super().close()
        self.flush()


def freshchoice_cards(raw: DataFrame) -> DataFrame:
    """The texts of the cards of FreshChoice pages, read page by page; other columns stay Arrow."""
    own = [f for f in raw.schema if f.name != "payload"]
    names = [c for c in CARD_COLUMNS if c not in ("seq", "next")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, seq, nexts, cards = [], [], [], []
            for i, payload in enumerate(b.column("payload").to_pylist()):
                page = Cards()
                page.feed(payload or "")
                page.close()
                n = len(page.cards)
                at += [i] * n
                seq += range(n)
                nexts += [page.next] * n
                cards += page.cards
            rows = pa.array(at, pa.int32())
            texts = {"seq": pa.array(seq, pa.int64()), **{c: pa.array([x.get(c) for x in cards], pa.string()) for c in names}, "next": pa.array(nexts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(rows) for f in own), *(texts[c] for c in CARD_COLUMNS)], [*(f.name for f in own), *CARD_COLUMNS])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "seq long", *(f"{c} string" for c in CARD_COLUMNS if c != "seq")])
    return raw.mapInArrow(run, fields)


def _text(c: str) -> Column:
    return F.nullif(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), F.lit(""))


def _money(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\$(\d+(?:\.\d+)?)", 1), F.lit("")).cast("decimal(12,4)")


def _measure(c: Column) -> Column:
    unit = F.lower(F.nullif(F.regexp_extract(c, r"(?i)per\s+([a-z0-9]+)", 1), F.lit("")))
    return F.when(unit == "kg", "1kg").when(unit == "l", "1L").when(unit.isin("each", "ea"), "1ea").otherwise(unit)


def freshchoice_unit(price: Column, comparison: Column, units: Column) -> Column:
    """Struct (unit_price, unit_of_measure): of the comparison, or else the sell price of what is sold per measure."""
    told, per = _money(comparison), F.coalesce(F.lower(units).startswith("per "), F.lit(False))
    return F.struct(F.when(told.isNotNull(), told).when(per, price).alias("unit_price"), F.when(told.isNotNull(), _measure(comparison)).when(per, _measure(units)).alias("unit_of_measure"))


def freshchoice_promo(price: Column, was: Column, multi: Column, sticker: Column, classes: Column) -> Column:
    """Struct (promo_type, non_special_price, multibuy_quantity, multibuy_total)."""
    has = lambda c: F.array_contains(F.split(classes, r"\s+"), f"talker--{c}")
    deal = F.coalesce(multi, F.when(has("Deal"), sticker))
    pair = r"(?i)(\d+)\s+for\s+\$(\d+(?:\.\d+)?)"
    n, total = F.nullif(F.regexp_extract(deal, pair, 1), F.lit("")), F.nullif(F.regexp_extract(deal, pair, 2), F.lit(""))
    old = F.when(_money(was) > price, _money(was))
    kind = F.when(old.isNotNull() | has("Special"), "Special").when(n.isNotNull(), "Multibuy").otherwise("None")
    return F.struct(kind.alias("promo_type"), old.cast("decimal(10,2)").alias("non_special_price"), n.cast("int").alias("multibuy_quantity"), total.cast("decimal(10,2)").alias("multibuy_total"))


def parse_freshchoice(raw: DataFrame, base_url: str = "", name: Column | None = None) -> DataFrame:
    """Products of FreshChoice pages (payload, scope, ...); the path is the scope's department."""
    own = [c for c in raw.columns if c != "payload"]
    rows = freshchoice_cards(raw)
    texts = {c: _text(c) for c in CARD_TEXT.values()}
    rows = rows.withColumns(texts).withColumn("price", _money(F.col("sell")).cast("decimal(10,2)"))
    rows = rows.where(~F.array_contains(F.split("classes", r"\s+"), "talker--placeholder") & ~_blank(F.col("sku")) & F.col("name").isNotNull() & F.col("price").isNotNull())
    rows = rows.withColumn("promo", freshchoice_promo(F.col("price"), F.col("was"), F.col("multi"), F.col("sticker"), F.col("classes")))
    rows = rows.withColumn("unit", freshchoice_unit(F.col("price").cast("decimal(12,4)"), F.col("comparison"), F.col("units")))
    label = F.regexp_replace("sticker", r"\s+", " ")
    tag = lambda c: F.when(F.array_contains(F.split("classes", r"\s+"), f"talker--{c}"), F.struct(F.lit("Primary").alias("source"), F.lit(c).alias("code"), label.alias("label")))
    path = F.array(_node("Department", F.col("scope"), F.col("scope"), name if name is not None else F.col("scope")))
    return rows.select(
        *own, "seq", "sku", "name", _none("string").alias("brand"), F.coalesce(F.col("size"), pack_size_from_name(F.col("name"))).alias("size"), _none("string").alias("gtin"),
        F.concat(F.lit(base_url), F.col("href")).alias("url"), F.col("image").alias("image_url"), "price", "promo.non_special_price", "promo.promo_type", _none("decimal(10,2)").alias("member_price"),
        "promo.multibuy_quantity", "promo.multibuy_total", "unit.unit_price", "unit.unit_of_measure", path.alias("category_path"), F.array_compact(F.array(tag("Special"), tag("Discount"), tag("Deal"))).alias("tags"),
    )

"""Prices and unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The loyalty programme of each chain.
LOYALTY = {"Woolworths": "Everyday Rewards", "NewWorld": "New World Clubcard", "PaknSave": None, "FreshChoice": None}
FOODSTUFFS = ("NewWorld", "PaknSave")


def comparable_unit_price(price: Column, uom: Column) -> Column:
    """Struct (price, unit) per kg, litre or each; null for other measures, a quantity of 0 or a null price."""
    text = F.lower(F.trim(uom))
    digits = F.regexp_extract(text, r"^([0-9.]*)", 1)
    quantity = F.when(digits == "", F.lit(1).cast("decimal(12,4)")).otherwise(F.coalesce(digits.try_cast("decimal(12,4)"), F.lit(1).cast("decimal(12,4)")))
    unit = F.trim(F.regexp_replace(text, r"^[0-9.]*", ""))
    label = F.when(unit.isin("kg", "g"), "1kg").when(unit.isin("l", "ml"), "1L").when(unit == "ea", "1ea")
    times = F.when(unit.isin("g", "ml"), 1000).otherwise(1)
    value = (price.cast("decimal(12,4)") / quantity * times).cast("decimal(18,6)")
    return F.when(label.isNotNull() & (quantity > 0) & price.isNotNull(), F.struct(value.alias("price"), label.alias("unit")))


def loyalty_program(chain: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LOYALTY.items():
        out = F.when(chain == k, F.lit(v)).otherwise(out)
    return out


def is_variable_weight(price: Column, unit_price: Column, uom: Column) -> Column:
    """Sold by weight: the price is the price of a kilogram or litre. Nulls are false."""
    by_weight = F.lower(uom).isin("1kg", "1l") & (F.abs(price - unit_price) < 0.001)
    return F.coalesce(by_weight, F.lit(False))


def in_foodstuffs(chain: Column) -> Column:
    return chain.isin(*FOODSTUFFS)

"""Names, brands and sizes: normal forms, tokens, slugs. Nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say nothing about a product.
STOP_WORDS = ("the", "a", "an", "and", "with", "of", "in", "for", "to", "or", "no", "nz")
SIZE_TOKEN = r"^[0-9]+(\.[0-9]+)?(g|kg|ml|l|pk|pack|ea|cm|mm|pc|pcs)$"


def normalize_brand(brand: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one space, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(brand), "[^a-z0-9]+", " ")), F.lit(""))


def normalize_size(size: Column) -> Column:
    """Lower case without spaces, packs as ``pk``; null without a digit."""
    plain = F.replace(F.lower(size), F.lit(" "), F.lit(""))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "packs?|pkts?", "pk"))


def tokenize(name: Column, brand: Column) -> Column:
    """Distinct telling tokens of a name: no stop words, brand tokens, sizes, numbers or single letters. A null name has none."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+")
    own = F.split(F.coalesce(normalize_brand(brand), F.lit("")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$") & ~w.rlike(SIZE_TOKEN))
    return F.array_except(F.array_distinct(kept), F.concat(F.array(*map(F.lit, STOP_WORDS)), own))


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens over those of the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^\\p{L}\\p{Nd}]+", "-"), "^-+|-+$", "")


def slugify(name: Column) -> Column:
    """Runs of other than letters and digits as one dash: the identity of a category."""
    return _slug(name)


def source_slugify(name: Column) -> Column:
    """As ``slugify``, with apostrophes dropped first: the slugs that shops use."""
    return _slug(F.regexp_replace(name, "['’]", ""))


def leading_phrases(name: Column) -> Column:
    """Array of (prio, phrase): the first three, two and one words, each extended while it ends in an ampersand."""
    words = F.filter(F.split(F.trim(name), " +"), lambda w: w != "")

    def phrase(n: int) -> Column:
        # The next place from n on whose word before it is not an ampersand.
        places = F.filter(F.sequence(F.lit(n), F.greatest(F.size(words), F.lit(n))), lambda k: F.get(words, k - 1) != "&")
        end = F.coalesce(F.get(places, F.lit(0)), F.size(words))
        return F.struct(F.lit(3 - n).alias("prio"), F.array_join(F.slice(words, 1, end), " ").alias("phrase"), (F.size(words) >= n).alias("there"))

    return F.filter(F.array(phrase(3), phrase(2), phrase(1)), lambda p: p.there)


def infer_brand(listings: DataFrame, vocabulary: DataFrame, key: str = "product_id", name: str = "raw_name") -> DataFrame:
    """(key, inferred): the longest leading phrase of the name whose normal form is in ``vocabulary`` (brand).

    Rows without such a phrase have no row in the result. The vocabulary is joined by Spark's own choice of
    strategy, so it may be of any size.
    """
    phrases = listings.select(key, F.explode(leading_phrases(F.col(name))).alias("p"))
    phrases = phrases.select(key, "p.prio", "p.phrase", normalize_brand(F.col("p.phrase")).alias("brand"))
    known = phrases.join(vocabulary.select("brand").distinct(), "brand")
    return known.groupBy(key).agg(F.min_by("phrase", "prio").alias("inferred"))


def pack_size_from_name(name: Column) -> Column:
    """``12pk`` from ``... 12 Pack``; null without a pack."""
    n = F.regexp_extract(name, r"(?i)(\d+)\s*(?:pack|pk)s?\b", 1)
    return F.when(n != "", F.concat(n, F.lit("pk")))

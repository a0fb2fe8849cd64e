"""Mix sources to target weights.

Tokens are summed per source; each source gets a target by water-filling (a share by weight, at most
``cap`` times its size, the excess shared again by weight), and from it a repetition rate. A document is
emitted floor(rate) times, plus once more when a hash of its id, as a number in [0, 1), is below the rate's
fraction. All of it is DataFrame code; per-document work needs no shuffle but one join with the sources.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a source
without words has target and rate 0; a null id hashes like an empty one; repeated rows are taken alike; an
empty table gives an empty mix; other columns pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, tune

WEIGHTS = (5.0, 2.0, 1.0)
#: Of the sources table: beyond it the join is a shuffled one with salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 32
RANGE_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def uniform(id_: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id: 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ranked(sources: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Add rank (from 0) by source, null last, without one task that sorts all: ranges, then offsets of ranges."""
    order = F.col("source").asc_nulls_last()
    ranges = sources.repartitionByRange(max(1, -(-n // RANGE_ROWS)), order).sortWithinPartitions(order)
    ranges = scratch.keep(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranked")
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    return ranges.join(F.broadcast(before.drop("n")), "part").select(
        "source", "source_size", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    )


def targets(spark: SparkSession, sources: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) of sources (source, source_size).

    Level is the target of a unit of weight. Each round holds the sources that reach their cap and shares
    the rest among the others, so it raises the level; it ends when no further source reaches its cap.
    """
    n = sources.count()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = scratch.keep(ranked(sources, scratch, n).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(cap)), "weights")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, held = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        caps, left, now = s.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now == held or not left:
            break
        held, level = now, (total - (caps or 0.0)) / left
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if n and left else F.col("cap")
    return s.withColumn("target", target.cast("double")).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


ADDED = ("size", "source_size", "target", "n_copies")


def _taken(spark: SparkSession, docs: DataFrame, seed: int, scratch: Scratch, **options) -> DataFrame:
    """(row: all columns of ``docs``, size, source_size, target, n_copies): names of columns cannot clash."""
    tune(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"))
    sources = scratch.keep(rows.groupBy(F.col("row.source").alias("source")).agg(F.sum("size").alias("source_size")), "sources")
    t = targets(spark, sources, scratch, **options)
    same = F.col("row.source").eqNullSafe(F.col("source"))
    if sources.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(t), same)
    else:
        salted = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = rows.withColumn("own_salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, same & (F.col("own_salt") == F.col("salt")))
    whole = F.floor("rate").cast("long")
    extra = (uniform(F.col("row.doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", (whole + extra).alias("n_copies"))


def copies(spark: SparkSession, docs: DataFrame, seed: int = 17, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and the number of copies the mix takes; columns of these names are replaced."""
    taken = _taken(spark, docs, seed, scratch or Scratch(spark, "mixing"), **options)
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def mix(spark: SparkSession, docs: DataFrame, seed: int = 17, scratch: Scratch | None = None, **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, with copy numbered from 0; an existing copy is replaced."""
    taken = _taken(spark, docs, seed, scratch or Scratch(spark, "mixing"), **options).where("n_copies > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies").cast("int") - 1)))
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "copy"], "copy")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = copies(spark, docs)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS caps_before,
         coalesce(sum(w) OVER b, 0) AS w_before
  FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  -- the level if exactly the sources before this one are held at their caps
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - caps_before) / (sum(w) OVER () - w_before) AS level FROM o),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1)) AS target FROM l),
r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

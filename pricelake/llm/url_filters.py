"""URL rules as nested intervals, joined by a sorted sweep with a stack of active rules.

A host is read from its last label, each label closed by a dot: ``example.net`` becomes ``net.example.``.
A rule's host and all its subdomains then are the keys that start with the rule's key, one interval. The
intervals nest. A sweep sorts interval starts and keys together and keeps, for each nesting level, the
interval that started last; at a key, the levels whose interval has not ended are the stack of active
rules. The hosts are swept first, then the paths below each active host. All of it is DataFrame code.

Both sweeps run over distinct keys and in cells: a hot group is cut into as many cells as its rows ask
for, and each cell gets the group's intervals. A cell holds at least as many rows as there are intervals,
so the copies never outnumber the rows.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; among
fitting rules the longest ``host + path`` wins, then the longer host, then the later verdict by name;
repeated rows are judged alike; no rules at all means the default verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, table, tune

#: (verdict, host, path) of the contract's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
CELL_ROWS = 4096
#: Greater than any byte of UTF-8, so that [p, p + END) holds all strings that start with p.
END = bytearray(b"\xff")


def host_path(url) -> tuple:
    whole = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, whole, 1), UPPER, LOWER), F.regexp_extract(text, whole, 2)


def host_key(host):
    """The canonical key of a host; as bytes, because intervals are compared as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def with_depth(intervals: DataFrame) -> DataFrame:
    """Nesting depth of distinct prefix intervals (grp, lo, hi): a running sum over starts and ends."""
    start = intervals.select("grp", F.col("lo").alias("pos"), F.lit(1).alias("step"), "lo", "hi")
    end = intervals.select("grp", F.col("hi").alias("pos"), F.lit(-1).alias("step"), "lo", "hi")
    run = W.partitionBy("grp").orderBy("pos", "step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return start.union(end).withColumn("depth", F.sum("step").over(run)).where("step = 1").select("grp", "lo", "hi", "depth")


def sweep(points: DataFrame, intervals: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add to distinct points (grp, key, ...) the stack: the starts of all intervals of the group that hold the key."""
    nested = with_depth(intervals.distinct())
    levels, n = nested.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count("*")).first()
    cells = max(1, -(-points.count() // max(cell_rows, n)))
    points = points.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    none = F.lit(None)
    starts = nested.join(points.select("grp", "cell").distinct(), "grp")
    events = points.withColumns({"at": F.lit(2), "lo": none.cast("binary"), "hi": none.cast("binary"), "depth": none.cast("long")}).unionByName(
        starts.withColumns({"key": F.col("lo"), "at": F.lit(1)}), allowMissingColumns=True
    )
    run = W.partitionBy("grp", "cell").orderBy("key", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    slot = lambda d: F.last(F.when(F.col("depth") == d, F.struct("lo", "hi")), ignorenulls=True).over(run)
    slots = [slot(d).alias(f"slot{d}") for d in range(1, levels + 1)]
    keep = [c for c in points.columns if c != "cell"]
    if not slots:
        return points.select(*keep, F.array().cast("array<binary>").alias("stack"))
    open_ = [F.when(F.col(f"slot{d}.hi") > F.col("key"), F.col(f"slot{d}.lo")) for d in range(1, levels + 1)]
    return events.select("*", *slots).where("at = 2").select(*keep, F.array_compact(F.array(*open_)).alias("stack"))


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url) under ``rules`` (verdict, host, path)."""
    tune(spark)
    scratch = scratch or Scratch(spark, "url-filters")
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = scratch.keep(rows.where("host <> ''").select("host", "path").distinct(), "urls")
    prefix = lambda c: (c.cast("binary"), F.concat(c.cast("binary"), F.lit(END)))

    rules = rules.where("host is not null and path is not null").select("verdict", "host", "path").distinct()
    rules = rules.withColumn("node", host_key(F.col("host")).cast("binary"))
    top = lambda key: F.substring_index(key, ".", 1)
    lo, hi = prefix(host_key(F.col("host")))
    nodes = rules.select(top(host_key(F.col("host"))).alias("grp"), lo.alias("lo"), hi.alias("hi"))
    hosts = urls.select("host").distinct().select("host", top(host_key(F.col("host"))).alias("grp"), host_key(F.col("host")).cast("binary").alias("key"))
    held = sweep(hosts, nodes).where("size(stack) > 0").select("host", F.explode("stack").alias("grp"))

    lo, hi = prefix(F.col("path"))
    paths = rules.select(F.col("node").alias("grp"), lo.alias("lo"), hi.alias("hi"))
    below = scratch.keep(urls.join(held, "host").withColumn("key", F.col("path").cast("binary")), "below")
    fits = sweep(below, paths).select("host", "path", F.col("grp").alias("node"), F.explode("stack").alias("lo"))
    named = rules.select("node", F.col("path").cast("binary").alias("lo"), F.concat("host", "path").alias("rule"), F.length("host").alias("len"), "verdict")
    best = (
        fits.join(named, ["node", "lo"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "len", "verdict", "rule")).alias("best"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(spark, table(spark, sf_dir, "pages"), rules)


OP3_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (
  SELECT host, path, max(struct_pack(n := length(h || p), verdict := verdict, rule := h || p)) AS best
  FROM (SELECT DISTINCT host, path FROM u) JOIN r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path
"""

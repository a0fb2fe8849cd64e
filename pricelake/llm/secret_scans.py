"""Secrets in texts: base patterns, and multipart credentials linked within a scope.

Base spans stand alone: assignments to a secret's name, access keys, long hexadecimal strings. Weak parts
do not: identifiers (``user=...``), endpoints (``scheme://host``) and bare random-looking tokens occur in
clean text. The scope of a weak part is its block, of any length (blocks are parted by blank lines). A weak
part is reported only if a complementary part meets its scope: a secret for an identifier or an endpoint,
one of these for a bare token. Blocks do not overlap, so the interval join is one on the row and the number
of the block; of each block only the roles that it holds are joined.

Defined cases: a null text is empty and has no spans; of equal starts the kinds go in the order of KINDS;
a weak part that overlaps a base span is not reported; repeated rows give repeated results; very long
texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tune

KINDS = ("assign", "access", "hex", "identifier", "endpoint", "secret")
ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""\b(?:user(?:name|id)?|login|account|client_?id|tenant_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]{4,}", re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind, without those that fail its length."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class Covered:
    """Sorted spans that may overlap, and whether another span meets one of them."""

    def __init__(self, spans) -> None:
        spans = sorted(spans)
        self.starts, self.tops = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def meets(self, s: int, e: int) -> bool:
        at = bisect_left(self.starts, e)
        return at > 0 and self.tops[at - 1] > s


def random_looking(token: str) -> bool:
    return bool(re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)) and len(set(token)) >= 10


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts, without those that overlap a base span and tokens inside an endpoint."""
    found = []
    if ":" in text or "=" in text:
        found += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    if "://" in text:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    found += [("secret", *m.span()) for m in TOKEN.finditer(text) if random_looking(m[0])]
    if not found:
        return []
    strong = Covered((s, e) for _, s, e in base)
    urls = Covered((s, e) for k, s, e in found if k == "endpoint")
    return [(k, s, e) for k, s, e in found if not strong.meets(s, e) and not (k == "secret" and urls.meets(s, e))]


def in_blocks(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """The spans with the numbers of the first and last block that they meet."""
    if not spans:
        return []
    blanks = [(m.start(), m.end()) for m in BLANK.finditer(text)]
    opens, closes = [b for _, b in blanks], [a for a, _ in blanks]
    return [(k, s, e, (first := bisect_right(opens, s)), max(first, bisect_left(closes, e))) for k, s, e in spans]


FIELDS = ("kind", "start", "end", "first", "last")
PART = pa.struct([("kind", pa.string()), *((x, pa.int64()) for x in FIELDS[1:])])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, weak = [], []
        for text in b.column("text"):
            t = text.as_py() or ""
            found = base_spans(t)
            weak.append(in_blocks(t, weak_spans(t, found)))
            base.append(in_blocks(t, found) if weak[-1] else [(*x, 0, 0) for x in found])
        named = lambda rows: pa.array([[dict(zip(FIELDS, x, strict=True)) for x in r] for r in rows], pa.list_(PART))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("row_key"),
                named(base),
                named(weak),
            ],
            ["doc_id", "row_key", "base", "weak"],
        )


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, base, weak) of each row of ``docs`` (doc_id, text): the parts found in its whole text."""
    part = "array<struct<kind: string, start: bigint, end: bigint, first: bigint, last: bigint>>"
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"doc_id {kind}, row_key bigint, base {part}, weak {part}")


def linked(found: DataFrame) -> DataFrame:
    """(row_key, linked): the weak parts of each row whose scope a complementary part meets."""
    some = found.where("size(weak) > 0").select("row_key", "base", "weak").dropDuplicates(["row_key"])
    blocks = F.explode(F.sequence("first", "last")).alias("block")
    scopes = some.select("row_key", F.explode("weak").alias("w")).select("row_key", "w.*").select("*", blocks).withColumn("role", role_of("kind"))
    every = some.select("row_key", F.explode(F.concat("base", "weak")).alias("p")).select("row_key", "p.*").select("row_key", blocks, role_of("kind").alias("p_role"))
    held = every.groupBy("row_key", "block").agg(F.bool_or(F.col("p_role") == "secret").alias("secret"), F.bool_or(F.col("p_role") != "secret").alias("other"))
    complementary = F.when(F.col("role") == "secret", F.col("other")).otherwise(F.col("secret"))
    hits = scopes.join(held, ["row_key", "block"]).where(complementary)
    return hits.select("row_key", "kind", "start", "end").distinct().groupBy("row_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def role_of(column: str):
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col(column))


def scan(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (kind, start, end) in order; spans has the linked weak parts as well."""
    tune(spark)
    scratch = scratch or Scratch(spark, "secrets")
    found = scratch.keep(parts(docs), "parts")
    ordered = lambda c: F.transform(
        F.array_sort(F.transform(c, lambda x: F.struct(x.start.alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x.kind).alias("rank"), x.end.alias("end"), x.kind.alias("kind")))),
        lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")),
    )
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    plain = lambda c: F.transform(c, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    both = found.join(linked(found), "row_key", "left")
    return both.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat(plain(F.col("base")), F.coalesce("linked", none))).alias("spans"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def brute_force(text: str | None) -> tuple[list, str]:
    """Base spans by the plain rule, for tests: every match of the pattern as written, failing ones dropped."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))
    return sorted(out), hashlib.sha256(said.encode()).hexdigest()

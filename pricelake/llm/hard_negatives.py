"""Mine hard negatives for anchors: clusters of anchors share one sorted list of candidates.

Anchors are clustered by angle. For a cluster, no member's inner product with a row can exceed the member's
norm times the row's norm times the cosine of the angle between row and centre less the widest angle of a
member, so the rows of a list are sorted by that bound once for all members. Every member walks its cluster's
list from the top and stops where the bound falls below what it needs: the least of its present best scores, a
lower bound of the final ones, so that the end is certified and nothing is lost.

A cluster's list lies in parts, one for each run of rows in a task; a member enters each part with what it
knows from those before and from a pilot over a fraction of the rows. Anchors go in blocks of bounded size,
each a stated set of queries against all rows; only best rows of each task leave it. Positives are mined first,
then negatives in a window of scores that follows from them.

Scores are exact integers: components are floored multiples, products are summed in single precision, double
precision or 64-bit integers, whichever holds them without loss.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; an empty
vector scores 0; of vectors of different lengths the common part is multiplied; sums beyond 64 bits wrap round;
repeated rows are rows each, but a row with the anchor's id is never its positive, and a repeated anchor mines
each time; ties go by the smaller id; an anchor without positives has no rows, one without negatives none for
that positive; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table, tune

SCALE = 256
#: Anchors of one block; clusters of a block and anchors of it that they are fitted on; rows of one part of a list.
BLOCK, CLUSTERS, FIT, PART = 32_768, 64, 8_192, 8_192
#: Rows of a list that members meet at a time, and the share of rows in the pilot.
STEP, PILOT = 512, 64
FOUND = "slot long, score long, vec_id long"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q: floored multiples of the components) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Vectors as rows of integers, shorter ones filled with zeros, which multiply to nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    wide = int(size.max(initial=0)) if dim is None else dim
    out = np.zeros((len(size), wide), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(size)), size)
    keep = at < wide
    out[row[keep], at[keep]] = values[keep]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``a`` with rows of ``b``."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm > 0, norm, 1)[:, None], norm


@dataclass
class Clusters:
    """Centres, the widest angle of each cluster's members, and the cluster of each anchor."""

    centres: np.ndarray
    angle: np.ndarray
    of: np.ndarray


def clustered(q: np.ndarray, k: int = CLUSTERS, fit: int = FIT, rounds: int = 8, seed: int = 5) -> Clusters:
    """Spherical k-means, fitted on at most ``fit`` of the anchors of a block; all of them are assigned."""
    u, norm = unit(q)
    rng = np.random.default_rng(seed)
    sample = u[rng.permutation(len(u))[:fit]]
    sample = sample[(sample != 0).any(1)]
    k = max(1, min(k, len(sample) // 4))
    centres = sample[:k] if len(sample) else np.zeros((1, q.shape[1]))
    for _ in range(rounds if len(sample) else 0):
        own = np.argmax(sample @ centres.T, 1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        fresh, size = unit(total)
        centres = np.where(size[:, None] > 0, fresh, centres)
    cosine = u @ centres.T
    of = np.argmax(cosine, 1)
    angle = np.zeros(len(centres))
    # An anchor without direction scores 0 with all rows, whatever the angle.
    np.maximum.at(angle, of, np.where(norm > 0, np.arccos(np.clip(cosine[np.arange(len(u)), of], -1, 1)), 0))
    return Clusters(centres, angle, of)


def bounds(rows: np.ndarray, centre: np.ndarray, angle: float) -> np.ndarray:
    """The most that a row's inner product with a member of norm 1 can be, a little above for rounding."""
    u, norm = unit(rows)
    between = np.arccos(np.clip(u @ centre, -1, 1))
    return norm * (np.cos(np.maximum(0, between - angle - 1e-6)) + 1e-9) + 1e-9


class Block:
    """Queries of a block of anchors. A slot asks for an anchor's ``k`` best rows of the same or of other labels with scores from low to high."""

    def __init__(self, ids, labels, q, slot, owner, same: bool, low, high, k: int, clusters: Clusters | None = None) -> None:
        self.ids, self.labels, self.q = ids, labels, q
        self.slot, self.owner, self.same, self.low, self.high, self.k = slot, owner, same, low, high, k
        self.clusters = clusters or clustered(q)
        self.norm = unit(q)[1]

    def walk(self) -> Walk:
        return Walk(self)


class Walk:
    """The best rows that a task has seen, slot by slot."""

    def __init__(self, b: Block) -> None:
        self.b, self.need, self.scored = b, b.low.copy(), 0
        self.order = np.argsort(b.owner, kind="stable")
        self.first = np.searchsorted(b.owner[self.order], np.arange(len(b.ids) + 1))
        self.slot, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple] = []
        self.waiting = 0

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the least score that any of its slots still takes, and the greatest."""
        least, most = np.full(len(self.b.ids), np.iinfo(np.int64).max), np.full(len(self.b.ids), np.iinfo(np.int64).min)
        np.minimum.at(least, self.b.owner, self.need)
        np.maximum.at(most, self.b.owner, self.b.high)
        return least, most

    def part(self, vec: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
        """Let all members walk the lists of their clusters over these rows."""
        b = self.b
        asked = np.diff(self.first) > 0
        for c in range(len(b.clusters.centres)):
            members = np.flatnonzero((b.clusters.of == c) & asked)
            if not len(members):
                continue
            bound = bounds(q, b.clusters.centres[c], b.clusters.angle[c])
            order = np.argsort(-bound, kind="stable")
            bound = bound[order]
            for at in range(0, len(order), STEP):
                least, most = self.least()
                members = members[b.norm[members] * bound[at] >= least[members] - 1e-3]
                if not len(members):
                    break  # certified: no row further down can be among the best of a member
                rows = order[at : at + STEP]
                scores = products(b.q[members], q[rows])
                self.scored += scores.size
                same = b.labels[members][:, None] == label[rows][None, :]
                ok = (scores >= least[members][:, None]) & (scores <= most[members][:, None]) & (same if b.same else ~same)
                if b.same:
                    ok &= b.ids[members][:, None] != vec[rows][None, :]
                m, r = np.nonzero(ok)
                self.take(members[m], scores[m, r], vec[rows[r]])
        self.settle()

    def take(self, anchor: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        n = self.first[anchor + 1] - self.first[anchor]
        at = np.repeat(np.arange(len(anchor)), n)
        slot = self.order[self.first[anchor][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        fits = (score[at] >= self.need[slot]) & (score[at] <= self.b.high[slot])
        self.new.append((slot[fits], score[at][fits], vec[at][fits]))
        self.waiting += int(fits.sum())
        if self.waiting > 4 * self.b.k * max(64, len(self.b.slot) // 8):
            self.settle()

    def settle(self) -> None:
        """Keep the best of each slot and raise what it needs."""
        if not self.new:
            return
        cols = [np.concatenate((old, *[n[i] for n in self.new])) for i, old in enumerate((self.slot, self.score, self.vec))]
        self.new, self.waiting = [], 0
        slot, score, vec = cols
        order = np.lexsort((vec, -score, slot))
        slot, score, vec = slot[order], score[order], vec[order]
        begin = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1)) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        self.slot, self.score, self.vec = (x[place < self.b.k] for x in (slot, score, vec))
        full = place == self.b.k - 1
        self.need[slot[full]] = np.maximum(self.need[slot[full]], score[full])


def best(rows: DataFrame, block: Block, part: int = PART) -> DataFrame:
    """(slot, score, vec_id): the best rows of each slot in each task."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        walk, waiting, n = b.walk(), [], 0

        def one() -> None:
            t = pa.Table.from_batches(waiting)
            walk.part(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("q"), b.q.shape[1]))

        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= part:
                one()
                waiting, n = [], 0
        if n:
            one()
        for i in range(0, len(walk.slot), 50_000):
            at = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(b.slot[walk.slot[at]]), pa.array(walk.score[at]), pa.array(walk.vec[at])], ["slot", "score", "vec_id"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """(slot, place, score, vec_id): the best of all tasks, of each at most k."""
    w = W.partitionBy("slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mined(rows: DataFrame, block: Block, scratch: Scratch, pilot: int = PILOT) -> DataFrame:
    """The best rows of each slot over all rows, after a pilot that tells each slot what it needs at least."""
    share = rows.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(pilot)) == 0)
    known = top(best(share, block), block.k).where(F.col("place") == block.k).select("slot", "score").toArrow()
    at = np.searchsorted(block.slot, known.column("slot").to_numpy())
    block.low = block.low.copy()
    block.low[at] = np.maximum(block.low[at], known.column("score").to_numpy())
    return scratch.keep(top(best(rows, block), block.k), "best")


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, anchors, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, pilot: int = PILOT, scratch: Scratch | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding).

    ``anchors`` is a condition on vec_id. Negatives of a positive score from low to high percent of it.
    """
    tune(spark)
    scratch = scratch or Scratch(spark, "hard-negatives")
    rows = scratch.keep(quantised(vectors), "rows")
    queries = rows.where(anchors)
    n = queries.count()
    spread = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(max(1, -(-n // block)))))
    spread = scratch.keep(spread.withColumn("slot", F.monotonically_increasing_id()), "anchors")
    out = None
    for i in range(max(1, -(-n // block))):
        # One bounded block of queries at a time passes through the driver on its way to all tasks.
        own = spread.where(F.col("block") == i).orderBy("slot").toArrow()
        slot, ids, labels, q = own.column("slot").to_numpy(), own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("q"))
        every = np.arange(len(ids))
        wide = np.iinfo(np.int64)
        first = Block(ids, labels, q, slot, every, True, np.full(len(ids), wide.min), np.full(len(ids), wide.max), n_positives)
        positives = mined(rows, first, scratch, pilot)
        found = positives.orderBy("slot", "place").toArrow()
        owner, score = np.searchsorted(slot, found.column("slot").to_numpy()), found.column("score").to_numpy()
        # Slots of negatives: one for each positive whose window of scores is not empty.
        lower, upper = -(-low * score // 100), high * score // 100
        some = lower <= upper
        asked = (owner * n_positives + found.column("place").to_numpy() - 1)[some]
        second = Block(ids, labels, q, asked, owner[some], False, lower[some], upper[some], n_negatives, first.clusters)
        negatives = mined(rows, second, scratch, pilot)
        number = spark.createDataFrame(pa.table({"slot": slot, "at": every, "anchor_id": ids}))
        p = positives.join(number, "slot").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("at") * n_positives + F.col("place") - 1).alias("slot"))
        each = p.join(negatives, "slot").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = each if out is None else out.unionByName(each)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(spark, vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

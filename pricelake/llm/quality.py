"""Quality by Bradley-Terry pairwise ranking.

A text is some twenty figures of its form (shares of letters, symbols and capitals, repetition of words and
lines, lengths), each spread over fixed soft steps at quantiles of all labelled rows that are not held out. Pairs of a good and a
bad one of these rows are preferences, and each row takes part in some; weights minimise the logistic loss on
differences of the pair's features over all pairs, by sums that Spark makes. The threshold is the quantile of all
these rows' scores that leaves below it the share of bad rows; scores are shifted so that it lies at 0.7.

Defined cases: a null text is an empty one and has a score; without rows of both labels every score is 1;
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Scratch, table, tune
from .kernel import byte_table, lowered, segment_hashes, texts, word_bounds
from .labelled import held_out, known

#: Rows of the rarer label in a bucket of ids, about, and pairs that each row of a bucket's larger class takes part in.
BUCKET, ROUNDS = 200, 2
THRESHOLD = 0.7
#: Penalty on squared weights; groups of sums that reach the driver; steps in which scores are counted.
DECAY, GROUPS, BINS = 1e-4, 8, 1 << 16
#: Places of the soft steps along a figure's range.
STEPS = 12


def figures(column) -> np.ndarray:
    """One row of figures a text."""
    space = byte_table(SPACE_BYTES)
    upper, lower, digit = byte_table(range(65, 91)), byte_table(range(97, 123)), byte_table(range(48, 58))
    stop, symbol = byte_table(b".,;:?'\"-()"), byte_table(b"!#$%&*+/<=>@[\\]^_`{|}~")
    out = []
    for _, offsets, data in texts(column):
        n = len(offsets) - 1
        per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
        size = np.maximum(np.diff(offsets), 1)
        starts, ends, bounds = word_bounds(data, offsets, space)
        words = np.diff(bounds)
        some = np.maximum(words, 1)
        by_word = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
        in_word = lambda t: np.concatenate(([0], np.cumsum(t[data])))
        of = lambda c: c[ends] - c[starts]
        length = ends - starts
        caps, low, odd = of(in_word(upper)), of(in_word(lower)), of(in_word(symbol))
        h = segment_hashes(lowered(data), starts, ends)
        text = np.repeat(np.arange(n), words)
        again = lambda k: np.concatenate((np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (text[k:] == text[:-k])))
        distinct, top = np.zeros(n), np.zeros(n)
        lines = np.zeros(n)
        breaks = (data == 10) | space[data] & False
        for i in range(n):
            own = h[bounds[i] : bounds[i + 1]]
            if len(own):
                _, counts = np.unique(own, return_counts=True)
                distinct[i], top[i] = len(counts), counts.max()
        l_starts, l_ends, l_bounds = word_bounds(np.where(breaks, 0, 1).astype(np.uint8), offsets, byte_table([0])) if len(data) else (starts, ends, bounds)
        lh = segment_hashes(data, l_starts, l_ends)
        for i in range(n):
            own = lh[l_bounds[i] : l_bounds[i + 1]]
            lines[i] = len(np.unique(own)) / len(own) if len(own) else 1
        root = np.sqrt(some)
        out.append(
            np.stack(
                [
                    np.log1p(words) / 10,
                    per(upper[data]) / size,
                    per(lower[data]) / size,
                    per(digit[data]) / size,
                    per(stop[data]) / size,
                    per(symbol[data]) / size,
                    per(data >= 128) / size,
                    by_word(odd > 0) / some,
                    by_word((caps > 1) & (low == 0)) / some,
                    by_word(again(1)) / some,
                    by_word(again(2)) / some,
                    by_word(again(5)) / some,
                    distinct / some,
                    distinct / root / 20,
                    top / some,
                    by_word(length) / some / 20,
                    by_word(length > 15) / some,
                    by_word(length <= 2) / some,
                    lines,
                    np.log1p(words / np.maximum(np.diff(l_bounds), 1)) / 10,
                ],
                1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, 20))


class Ranker:
    """score = weights on soft steps of the figures, shifted so that the threshold lies at THRESHOLD."""

    def __init__(self, q: np.ndarray) -> None:
        # Steps lie at quantiles of the figures, with the distance to the next as their width.
        self.low, self.width = q[:-1], np.maximum(np.diff(q, axis=0), 1e-6)
        self.weight = np.zeros(self.low.size)
        self.cut, self.slope = 0.0, 1.0

    @classmethod
    def of(cls, state: dict | None):
        """The model with that state; broadcasts carry the state only."""
        if state is None:
            return None
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x[:, None, :] - self.low) / self.width, 0, 1).reshape(len(x), -1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) * self.slope * 2 + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 20))


def labelled(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label, x) of every labelled row that is not held out and has a text: x holds its figures, so texts stay where they are."""

    def run(batches):
        for b in batches:
            x = figures(b.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")
    return told.join(known(labels, "quality", modulus, remainder), "doc_id").select("doc_id", "label", "x")


def quantiles(rows: DataFrame) -> np.ndarray:
    """STEPS quantiles of each figure over all ``rows``, by counts of its values to 11 bits behind the leading one."""
    value = F.col("v").cast("double")
    scale = F.pow(F.lit(2.0), F.lit(11) - F.floor(F.log2(value)))
    near = F.when(value > 0, F.floor(value * scale) / scale).otherwise(F.lit(0.0))
    counts = rows.select(F.posexplode("x").alias("figure", "v")).groupBy("figure", near.alias("v")).agg(F.count("*").alias("n"))
    own = W.partitionBy("figure")
    place = counts.select("figure", "v", F.sum("n").over(own.orderBy("v")).alias("upto"), F.sum("n").over(own).alias("all"))
    shares = [i / (STEPS - 1) for i in range(STEPS)]
    least = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * s)), F.col("v"))).alias(f"q{i}") for i, s in enumerate(shares)]
    got = place.groupBy("figure").agg(*least).orderBy("figure").collect()
    return np.array([list(r)[1:] for r in got]).T


def pairs(rows: DataFrame, n: int) -> DataFrame:
    """(good, bad): figures of preference pairs. Every row takes part: rows meet within buckets of ids, the smaller class of one goes round."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("order")
        x, label = matrix(t.column("x").combine_chunks()).astype(np.float32), t.column("label").to_numpy()
        good, bad = x[label == 1], x[label == 0]
        m = max(len(good), len(bad)) if len(good) and len(bad) else 0
        at = np.arange(m)
        a = [good[at % len(good)] for _ in range(ROUNDS)] if m else []
        b = [bad[(at + k) % len(bad)] for k in range(ROUNDS)] if m else []
        lists = lambda rows: pa.array([r for part in rows for r in part], pa.list_(pa.float32()))
        return pa.table([lists(a), lists(b)], ["good", "bad"])

    key = F.xxhash64("doc_id")
    spread = rows.select(F.pmod(key, F.lit(max(1, n // BUCKET))).alias("bucket"), F.xxhash64(F.lit(1), "doc_id", "x").alias("order"), "label", "x")
    return spread.groupBy("bucket").applyInArrow(run, "good array<float>, bad array<float>").select("good", "bad")


def newton(told: DataFrame, ranker: Ranker, decay: float = DECAY, rounds: int = 12) -> None:
    """Minimises the mean logistic loss over all pairs ``told`` and decay / 2 * |weight|^2 by Newton's steps, each one pass over the pairs."""
    size = len(ranker.weight)

    def step(weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        state = {**vars(ranker), "weight": weight}

        def run(batches):
            r, n, loss, g, h = Ranker.of(state), 0, 0.0, np.zeros(size), np.zeros((size, size))
            for b in batches:
                d = r.features(matrix(b.column("good"))) - r.features(matrix(b.column("bad")))
                z = np.clip(d @ r.weight, -30, 30)
                p = 1 / (1 + np.exp(z))
                n, loss = n + len(z), loss + np.log1p(np.exp(-z)).sum()
                g, h = g - p @ d, h + (d * (p * (1 - p))[:, None]).T @ d
            if n:
                out = np.concatenate(([n, loss], g, h.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["sums"])

        def total(t: pa.Table) -> pa.Table:
            rows = matrix(t.sort_by("part").column("sums").combine_chunks())
            return pa.table([pa.array([rows.sum(0)], pa.list_(pa.float64()))], ["sums"])

        # A matrix a task; few groups of them reach the driver.
        each = told.mapInArrow(run, "sums array<double>").withColumn("part", F.spark_partition_id())
        parts = each.groupBy((F.col("part") % GROUPS).alias("group")).applyInArrow(total, "sums array<double>").toArrow()
        got = matrix(parts.column("sums").combine_chunks())
        sums = got[np.lexsort(got.T[::-1])].sum(0)
        n, g, h = sums[0], sums[2 : 2 + size], sums[2 + size :].reshape(size, size)
        return sums[1] / n + decay / 2 * weight @ weight, g / n + decay * weight, h / n + decay * np.eye(size)

    weight = ranker.weight
    loss, g, h = step(weight)
    for _ in range(rounds):
        move, part = np.linalg.solve(h, g), 1.0
        if g @ move < 1e-7:
            break
        while True:
            new = weight - part * move
            told_new = step(new)
            if told_new[0] <= loss or part < 1e-3:
                break
            part /= 2
        weight, (loss, g, h) = new, told_new
    ranker.weight = weight


def calibrate(rows: DataFrame, ranker: Ranker, bad_share: float) -> None:
    """The cut that leaves the share of bad rows below it, and the slope from the medians of both labels, by counts of all rows' scores in BINS steps."""
    state = vars(ranker).copy()
    # A score lies between the sums of the negative and of the positive weights.
    low, high = float(np.minimum(ranker.weight, 0).sum()), float(np.maximum(ranker.weight, 0).sum())
    width = max(high - low, 1e-9) / BINS

    def run(batches):
        r = Ranker.of(state)
        for b in batches:
            at = np.clip(np.floor((r.raw(matrix(b.column("x"))) - low) / width), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("label")], ["at", "label"])

    got = rows.select("x", "label").mapInArrow(run, "at int, label int").groupBy("label", "at").count().collect()
    n = np.zeros((2, BINS))
    for r in got:
        n[r["label"], r["at"]] += r["count"]
    both = np.cumsum(n.sum(0))
    full = np.flatnonzero(n.sum(0))
    # The middle between the last step of the share and the next one that holds rows.
    last = int(np.searchsorted(both, bad_share * both[-1]))
    after = full[full > last]
    after = int(after[0]) if len(after) else last + 1
    ranker.cut = low + ((last + 0.5) + (after + 0.5)) / 2 * width
    median = [int(np.searchsorted(np.cumsum(c), c.sum() / 2)) for c in n]
    ranker.slope = float(3 / max(1e-6, (median[1] - median[0]) * width))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> Ranker | None:
    """A ranker fitted on all labelled rows that are not held out; None without both labels."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = scratch.keep(labelled(docs, labels, modulus, remainder), "rows")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(count) < 2:
        return None
    r = Ranker(quantiles(rows))
    told = scratch.keep(pairs(rows, min(count.values())), "pairs")
    newton(told, r)
    calibrate(rows, r, count[0] / (count[0] + count[1]))
    return r


def score(spark: SparkSession, docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``docs`` (text, ...) with a column ``score`` added; an existing one of that name is replaced."""
    sent = spark.sparkContext.broadcast(vars(ranker) if ranker else None)

    def run(batches):
        r = Ranker.of(sent.value)
        for b in batches:
            s = np.ones(len(b)) if r is None else r.score(figures(b.column("text")))
            names = [c for c in b.schema.names if c != "score"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s, pa.float64())], [*names, "score"])

    docs = docs.drop("score")
    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score(spark, docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and the first four and five letters of longer ones, hashed to a
fixed space. The machine has a weight for each term and a short vector for each, whose products weigh
pairs of terms, so that a pair can count for more than its words, also where neither word tells anything
alone. It is fitted on a bounded sample of labelled rows and sent to all tasks; its size is that of the hash
space, whatever the input. No term is left out for being common in both labels: weights pay an absolute
penalty, a smaller one the further a term's shares of texts lie apart (an adaptive lasso), and vectors one
on their length that is the same for all terms. Only terms of fewer rows than ``ROWS_TO_WEIGH`` and
``ROWS_TO_PAIR`` have no weight and no vector, however large the sample is.

Defined cases: a null or empty text has no terms and gets the score of none; without rows of both labels
every score is 0; of repeated labels of an id the greatest counts; repeated rows and rows with equal terms
get equal scores; a score that equals the threshold is toxic; texts are read whole, of any length, one text
being one piece of work; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune
from .kernel import U, byte_table, lowered, segment_hashes, texts, word_bounds
from .labelled import held_out, sample

#: Bits of the hash space, length of a term's vector, and rows of each class that the fit sees at most.
BITS, FACTORS, ROWS_PER_CLASS = 18, 4, 4000
#: Rows of the sample that must hold a term for it to have a weight, and a vector.
ROWS_TO_WEIGH, ROWS_TO_PAIR = 2, 10
#: Penalties on weights and on the length of vectors, and the standard errors from which on a weight pays less.
SPARSE, SHORT, TELLING = 0.03, 0.006, 1.5
THRESHOLD = 0.7
#: ASCII that parts words: all but letters and digits.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def terms(column, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct hashed terms of each text, in order of rows."""
    space, shift = byte_table(SEPARATORS), U(64 - bits)
    for _, offsets, data in texts(column):
        data = lowered(data)
        starts, ends, bounds = word_bounds(data, offsets, space)
        found = [(segment_hashes(data, starts, ends) >> shift).astype(np.int32)]
        for n in (4, 5):
            head = np.minimum(ends, starts + n)
            h = segment_hashes(data, starts, head) * U(2 * n + 1)
            found.append(np.where(ends - starts > n, (h >> shift).astype(np.int32), found[0]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(np.concatenate([f[a:b] for f in found]))


def penalties(rows: list[np.ndarray], label: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold each term, the penalty on its weight): less where its shares of the labels' texts lie far apart."""
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    count = lambda c: np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, y in zip(rows, label, strict=True) if y == c)]), minlength=space)
    in1, in0 = count(1), count(0)
    p = (in1 + in0 + 1) / (n1 + n0 + 2)
    apart = np.abs(in1 / n1 - in0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return in1 + in0, (SPARSE * np.minimum(1, (TELLING / np.maximum(apart, 1e-9)) ** 2)).astype(np.float32)


class Machine:
    """bias + sum of weights + pairwise products of vectors; scores are calibrated so that THRESHOLD is the best cut."""

    def __init__(self, bits: int = BITS, factors: int = FACTORS) -> None:
        self.bias = 0.0
        self.weight = np.zeros(1 << bits, np.float32)
        self.vector = np.random.Generator(np.random.PCG64(5)).normal(0, 0.05, (1 << bits, factors)).astype(np.float32)
        self.cut, self.slope = 0.0, 1.0

    @classmethod
    def of(cls, state: dict | None):
        """The model with that state; broadcasts carry the state only."""
        if state is None:
            return None
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        some = np.flatnonzero(size)
        if len(some):
            ids = np.concatenate([rows[i] for i in some])
            at = np.concatenate(([0], np.cumsum(size[some])[:-1]))
            v = self.vector[ids]
            pair = np.add.reduceat(v, at) ** 2 - np.add.reduceat(v * v, at)
            out[some] += np.add.reduceat(self.weight[ids], at) + 0.5 * pair.sum(1)
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = (self.raw(rows) - self.cut) * self.slope + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[np.ndarray], label: np.ndarray, epochs: int = 25, rate: float = 0.2) -> None:
        """Adagrad on the logistic loss with the penalties taken off after each step; a tenth of the rows sets the cut and slope."""
        rng = np.random.Generator(np.random.PCG64(3))
        check = rng.random(len(rows)) < 0.1
        held, sparse = penalties([r for r, c in zip(rows, check, strict=True) if not c], label[~check], len(self.weight))
        self.vector[held < ROWS_TO_PAIR] = 0
        rows = [r[held[r] >= ROWS_TO_WEIGH] for r in rows]
        train = np.flatnonzero(~check)
        g_w, g_v, g_b = np.full_like(self.weight, 1e-3), np.full_like(self.vector, 1e-3), 1e-3
        for _ in range(epochs):
            rng.shuffle(train)
            for batch in np.array_split(train, max(1, len(train) // 64)):
                batch = np.array([i for i in batch if len(rows[i])], np.int64)
                if not len(batch):
                    continue
                part = [rows[i] for i in batch]
                err = 1 / (1 + np.exp(-np.clip(self.raw(part), -30, 30))) - label[batch]
                self.bias -= rate * err.mean() / np.sqrt(g_b := g_b + err.mean() ** 2)
                size = np.array([len(r) for r in part])
                ids, each = np.concatenate(part), np.repeat(err, size) / len(part)
                sums = np.add.reduceat(self.vector[ids], np.concatenate(([0], np.cumsum(size)[:-1])))
                used, inverse = np.unique(ids, return_inverse=True)
                d_w = np.bincount(inverse, each).astype(np.float32)
                per = each[:, None] * (np.repeat(sums, size, 0) - self.vector[ids])
                d_v = np.stack([np.bincount(inverse, per[:, k]) for k in range(per.shape[1])], 1).astype(np.float32)
                g_w[used] += d_w**2
                g_v[used] += d_v**2
                step = rate / np.sqrt(g_w[used])
                w = self.weight[used] - step * d_w
                self.weight[used] = np.sign(w) * np.maximum(np.abs(w) - step * sparse[used], 0)
                step = 0.2 * rate / np.sqrt(g_v[used])
                v = self.vector[used] - step * d_v
                length = np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12
                self.vector[used] = v * np.maximum(1 - step.mean(1, keepdims=True) * SHORT / length, 0)
        self.calibrate(self.raw([rows[i] for i in np.flatnonzero(check)]), label[check])

    def calibrate(self, raw: np.ndarray, label: np.ndarray) -> None:
        """The cut with fewest errors (the middle of the widest gap among equals); the slope from the classes' distance."""
        if not (label == 0).any() or not (label == 1).any():
            return
        order = np.argsort(raw)
        z, y = raw[order], label[order]
        errors = np.concatenate(([0], np.cumsum(y))) + (y == 0).sum() - np.concatenate(([0], np.cumsum(y == 0)))
        ends = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
        width = ends[1:] - ends[:-1]
        best = np.flatnonzero(errors == errors.min())
        k = best[np.argmax(width[best])]
        self.cut = float((ends[k] + ends[k + 1]) / 2)
        self.slope = float(min(10.0, 4 / max(1e-6, np.median(z[y == 1]) - np.median(z[y == 0]))))


def fit(rows: DataFrame, **options) -> Machine | None:
    """A machine fitted on rows (text, label) of a bounded sample; None without both labels."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in terms(b.column("text"))], pa.binary()), b.column("label"), b.column("doc_id")], ["terms", "label", "doc_id"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"terms binary, label int, doc_id {kind}").toArrow().to_pydict()
    order = np.argsort(np.array(got["doc_id"], dtype=object), kind="stable") if got["doc_id"] else []
    label = np.array([got["label"][i] for i in order], np.float64)
    if len(set(label)) < 2:
        return None
    m = Machine()
    m.fit([np.frombuffer(got["terms"][i], np.int32) for i in order], label)
    return m


def score(spark: SparkSession, docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    sent = spark.sparkContext.broadcast(vars(machine) if machine else None)

    def run(batches):
        m = Machine.of(sent.value)
        for b in batches:
            out = np.zeros(len(b)) if m is None else m.score(list(terms(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(sample(docs, labels, "toxic", 3, 1, ROWS_PER_CLASS))
    return score(spark, docs, machine).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

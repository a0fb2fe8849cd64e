"""Language identification by interpolated Kneser-Ney character models.

All training texts are counted: runs of letters, lower-cased, parted by one space, as 4-grams of
characters per language. From the counts come, for each language, discounted 4-gram probabilities that
fall back on shorter grams, which are weighed by the number of different characters before them; each
language has its own discounts. Characters are those of the texts, in 16 bits each, so a gram is one exact
64-bit number; letters beyond the first plane are two of them.

Counts, discounts and probabilities are DataFrame aggregations over all grams, none of which is cut, and the
models are a written table. Scoring takes it in shards of bounded size: everything that the probability of a
gram can fall back on lies in the shard of the gram's last character but one. A shard goes to all tasks as
arrays sorted by the hash of the gram, one set for each language; a text's entropies are sums over shards. Few
shards are one pass over the texts each.
A text gets the language whose model gives the lowest cross-entropy a character. Entropies of all training
texts give for each language a bound; a text beyond it is marked as rejected and scores less.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training texts every
text is ``und``; ties go to the language first by name; repeated rows get equal results; texts are read
whole, of any length, one being one piece of work; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tune
from .kernel import U, mix, texts
from .labelled import held_out

ORDER = 4
#: Standard deviations from the mean entropy of a language's texts to its bound.
REJECT = 4.0
#: Characters that count as evidence in a score, at most: a longer text is no surer than one of so many.
EVIDENCE = 60
#: Rows of the models that one shard holds, or about that.
SHARD = 4_000_000
SPACE = 32


def lowering() -> np.ndarray:
    """For each character of the first plane its lower-case letter, or a space where it is no letter."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(data: np.ndarray, offsets: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of 16 bits, text of each, whether each text has a letter): a space before and after each run of letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(first)))[offsets]
    wide = points > 0xFFFF
    units = low[np.where(wide, SPACE, points).astype(np.uint16)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    if wide.any():
        letters = [(c, np.frombuffer(chr(c).lower()[:1].encode("utf-16-le"), np.uint16)) for c in np.unique(points[wide]).tolist() if chr(c).isalpha()]
        second = np.zeros(len(points), np.uint16)
        for c, two in letters:
            units[points == c], second[points == c] = two[0], two[-1]
        more = np.flatnonzero(second)
        units, text = np.insert(units, more + 1, second[more]), np.insert(text, more + 1, text[more])
    letter = units != SPACE
    some = np.bincount(text[letter], minlength=len(offsets) - 1) > 0
    # A space goes in only after a letter of the same text; the first and last of a text are added.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (text[1:] == text[:-1])
    order_text, order_char = text[keep], units[keep]
    starts = np.searchsorted(order_text, np.arange(len(offsets) - 1))
    return np.insert(order_char, starts, SPACE), np.insert(order_text, starts, np.arange(len(offsets) - 1)), some


def grams(chars: np.ndarray, text: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(the gram that ends at each character, its text), 16 bits a character; texts begin after empty ones (0)."""
    code = chars.astype(U)
    out = code.copy()
    for k in range(1, order):
        before = np.concatenate((np.zeros(k, U), code[:-k])) if len(code) > k else np.zeros(len(code), U)
        same = np.concatenate((np.zeros(k, bool), text[k:] == text[:-k])) if len(code) > k else np.zeros(len(code), bool)
        out |= np.where(same, before, U(0)) << U(16 * k)
    return out, text


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs`` (text, lang): summed in each task before the shuffle."""

    def run(batches):
        low, sums = lowering(), {}

        def rows():
            for lang, (g, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            langs = b.column("lang").to_pylist()
            for row, offsets, data in texts(b.column("text")):
                own = np.array(langs[row : row + len(offsets) - 1], dtype=object)
                g, text = grams(*characters(data, offsets, low)[:2])
                g, text = g[g & U(0xFFFF) != 0], text[g & U(0xFFFF) != 0]
                for lang in set(own):
                    mine, n = np.unique(g[np.isin(text, np.flatnonzero(own == lang))], return_counts=True)
                    if lang in sums:
                        mine, at = np.unique(np.concatenate((sums[lang][0], mine)), return_inverse=True)
                        n = np.bincount(at, np.concatenate((sums[lang][1], n)), len(mine)).astype(np.int64)
                    sums[lang] = (mine, n)
            if sum(len(g) for g, _ in sums.values()) > 1_000_000:
                yield from rows()
                sums = {}
        yield from rows()

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def lower_gram(gram: Column, k: int) -> Column:
    """The last k characters."""
    return gram.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < 4 else gram


def model_table(counted: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(lang, k, rest, gram, value): for each gram of k characters the log-probability of its last one, and, as ``rest``, for what comes before it the logarithm of what is left for shorter grams."""
    tables = {order: scratch.keep(counted.select("lang", "gram", F.col("n").alias("c")), "grams")}
    for k in range(order - 1, 0, -1):
        # Of shorter grams the different characters before them count.
        longer = tables[k + 1].select("lang", lower_gram(F.col("gram"), k).alias("gram"))
        tables[k] = scratch.keep(longer.groupBy("lang", "gram").agg(F.count("*").alias("c")), "grams")
    alphabet = max(2, tables[1].select("gram").distinct().count())
    below, out = None, None
    for k in range(1, order + 1):
        rows = tables[k].withColumn("context", F.shiftrightunsigned("gram", 16))
        seen = rows.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"))
        # Without grams seen once there is nothing to estimate a discount from.
        d = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.when(F.col("once") > 0, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5)))
        seen = seen.select("lang", d.alias("d"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(seen, "lang")
        contexts = scratch.keep(contexts.select("lang", "context", "d", "total", (F.col("d") * F.col("kinds") / F.col("total")).alias("share")), "contexts")
        p = rows.withColumn("suffix", lower_gram(F.col("gram"), k - 1)).join(contexts, ["lang", "context"])
        if below is None:
            p = p.withColumn("below", F.lit(1.0 / (alphabet + 1)))
        else:
            p = p.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = p.select("lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("share") * F.col("below")).alias("p"))
        below = scratch.keep(p, "probabilities")
        part = below.select("lang", F.lit(k).alias("k"), F.lit(False).alias("rest"), "gram", F.ln("p").cast("float").alias("value"))
        part = part.unionByName(contexts.select("lang", F.lit(k).alias("k"), F.lit(True).alias("rest"), F.col("context").alias("gram"), F.ln("share").cast("float").alias("value")))
        out = part if out is None else out.unionByName(part)
    return scratch.keep(out.withColumn("floor", F.lit(-float(np.log(alphabet + 1)))), "models")


def shard_of(unit, n: int):
    """The shard of a character of 16 bits, as a column or as numbers."""
    return F.pmod(unit * F.lit(40503), F.lit(n)) if isinstance(unit, Column) else (unit.astype(np.int64) * 40503) % n


class Shard:
    """One language's part of a shard: arrays sorted by the hash of gram and length."""

    def __init__(self, k: np.ndarray, rest: np.ndarray, gram: np.ndarray, value: np.ndarray) -> None:
        h = mix(gram.view(U) ^ mix(k.astype(U)))
        self.keys, self.value = [], []
        for kind in (False, True):
            own = np.flatnonzero(rest == kind)
            order = own[np.argsort(h[own])]
            self.keys.append(h[order]), self.value.append(value[order])

    def found(self, kind: bool, gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        keys, value = self.keys[kind], self.value[kind]
        if not len(keys):
            return np.zeros(len(gram)), np.zeros(len(gram), bool)
        h = mix(gram ^ mix(np.full(1, k, U)))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return value[at], keys[at] == h

    def log_prob(self, gram: np.ndarray, floor: float, order: int = ORDER) -> np.ndarray:
        """Of each gram of ``order`` characters the log-probability of the last one after the others."""
        out, left, so_far = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
        for k in range(order, 0, -1):
            value, hit = self.found(False, gram[left], k)
            out[left[hit]] = so_far[left[hit]] + value[hit]
            left = left[~hit]
            if not len(left):
                return out
            value, known = self.found(True, gram[left] >> U(16), k)
            so_far[left] += np.where(known, value, 0)
            gram = gram & U((1 << 16 * (k - 1)) - 1)
        out[left] = so_far[left] + floor
        return out


@dataclass
class Models:
    """The table of all models, its languages by name, its number of shards, and each language's mean and deviation of entropies."""

    rows: DataFrame
    langs: list[str]
    shards: int
    floor: float
    mean: list[float]
    deviation: list[float]

    def shard(self, i: int) -> list[Shard]:
        unit = F.when(F.col("rest"), F.col("gram").bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF)))
        rows = self.rows.where((F.col("k") == 1) | (shard_of(unit, self.shards) == i))
        number = F.array_position(F.array(*map(F.lit, self.langs)), F.col("lang")) - 1
        got = rows.select(number.cast("int").alias("lang"), "k", "rest", "gram", "value").toArrow()
        lang, k, rest, gram, value = (got.column(c).to_numpy() for c in ("lang", "k", "rest", "gram", "value"))
        return [Shard(k[own], rest[own], gram[own], value[own]) for own in (lang == j for j in range(len(self.langs)))]


def entropies(spark: SparkSession, docs: DataFrame, m: Models, scratch: Scratch) -> DataFrame:
    """``docs`` (text and others) without texts, with ``nats`` a character in each language, ``size`` and whether it has a letter (``some``)."""
    others = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    if m.shards > 1:
        docs = scratch.keep(docs.withColumn("row_no", F.monotonically_increasing_id()), "texts")
        others, kinds = [*others, "row_no"], f"{kinds}, row_no long"
    out = None
    for i in range(m.shards):
        each = one_shard(docs, spark.sparkContext.broadcast(m.shard(i)), i, m, others, kinds)
        each = each if m.shards == 1 else scratch.keep(each, "sums")
        out = each if out is None else out.unionByName(each)
    if m.shards > 1:
        # One row a shard.
        plus = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
        total = F.aggregate(F.collect_list("total"), F.array().cast("array<double>"), plus)
        out = out.groupBy("row_no").agg(*[F.first(c).alias(c) for c in others[:-1]], total.alias("total"), F.first("size").alias("size"), F.first("some").alias("some")).drop("row_no")
    return out.withColumn("nats", F.transform("total", lambda x: -x / F.greatest(F.col("size"), F.lit(1)))).drop("total")


def one_shard(docs: DataFrame, sent, i: int, m: Models, others: list[str], kinds: str) -> DataFrame:
    n_langs, shards, floor = len(m.langs), m.shards, m.floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, models = lowering(), sent.value
        seen, value = np.zeros(0, U), np.zeros((0, n_langs))
        for b in batches:
            total, size, some = np.zeros((len(b), n_langs)), np.zeros(len(b), np.int64), np.zeros(len(b), bool)
            for row, offsets, data in texts(b.column("text")):
                chars, text, letters = characters(data, offsets, low)
                g, _ = grams(chars, text)
                n = len(offsets) - 1
                size[row : row + n], some[row : row + n] = np.bincount(text, minlength=n), letters
                if shards > 1:
                    own = shard_of((g >> U(16)) & U(0xFFFF), shards) == i
                    g, text = g[own], text[own]
                kinds_, at = np.unique(g, return_inverse=True)
                # Grams met before in this task keep their values; the store is emptied before it grows large.
                new = kinds_[~np.isin(kinds_, seen, assume_unique=True)]
                if len(new):
                    if len(seen) > 500_000:
                        seen, value, new = np.zeros(0, U), np.zeros((0, n_langs)), kinds_
                    both = np.concatenate((seen, new))
                    order = np.argsort(both)
                    fresh = np.stack([model.log_prob(new, floor) for model in models], 1)
                    seen, value = both[order], np.concatenate((value, fresh))[order]
                own = value[np.searchsorted(seen, kinds_)]
                for k in range(n_langs):
                    total[row : row + n, k] = np.bincount(text, own[at, k], n)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * n_langs), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], sums, pa.array(size), pa.array(some)], [*others, "total", "size", "some"])

    return docs.select(*others, "text").mapInArrow(run, f"{kinds}, total array<double>, size long, some boolean")


def train(spark: SparkSession, docs: DataFrame, shard: int = SHARD, scratch: Scratch | None = None) -> Models | None:
    """Models of all languages of ``docs`` (doc_id, text, lang); rows without text or language are left out."""
    scratch = scratch or Scratch(spark, "language-id")
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counted = scratch.keep(counts(docs), "counts")
    # There are few languages.
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not langs:
        return None
    rows = model_table(counted, scratch)
    n, floor = rows.agg(F.count("*"), F.min("floor")).first()
    m = Models(rows, langs, max(1, -(-n // shard)), floor, [0.0] * len(langs), [float("inf")] * len(langs))
    return calibrated(spark, m, docs, scratch)


def calibrated(spark: SparkSession, m: Models, docs: DataFrame, scratch: Scratch) -> Models:
    """The models with mean and deviation of the entropy of all of each language's own texts."""
    each = entropies(spark, docs.select("lang", "text"), m, scratch).where("some")
    own = F.get("nats", F.array_position(F.array(*map(F.lit, m.langs)), F.col("lang")).cast("int") - 1)
    known = {r.lang: r for r in each.groupBy("lang").agg(F.avg(own).alias("m"), F.stddev_pop(own).alias("s")).collect()}
    mean = [known[x].m if x in known else 0.0 for x in m.langs]
    return replace(m, mean=mean, deviation=[max(known[x].s, 0.02) if x in known else float("inf") for x in m.langs])


def identify(spark: SparkSession, docs: DataFrame, models: Models | None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of each row of ``docs`` (doc_id, text)."""
    docs, m = docs.select("doc_id", "text"), models
    if m is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    each = entropies(spark, docs, m, scratch or Scratch(spark, "language-id"))
    each = each.withColumn("low", F.array_min("nats")).withColumn("best", (F.array_position("nats", F.col("low")) - 1).cast("int"))
    evidence = F.least("size", F.lit(EVIDENCE))
    p = 1 / F.aggregate("nats", F.lit(0.0), lambda a, x: a + F.exp(-(x - F.col("low")) * evidence))
    of = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("best"))
    rejected = F.col("low") > of([a + REJECT * d for a, d in zip(m.mean, m.deviation)])
    return each.select(
        "doc_id",
        F.when(F.col("some"), F.get(F.array(*map(F.lit, m.langs)), F.col("best"))).otherwise("und").alias("lang_pred"),
        F.when(F.col("some"), F.when(rejected, p / 2).otherwise(p)).otherwise(0.0).alias("score"),
        F.when(F.col("some"), F.col("low")).alias("entropy"),
        (rejected | ~F.col("some")).alias("rejected"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    return identify(spark, docs, train(spark, docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")

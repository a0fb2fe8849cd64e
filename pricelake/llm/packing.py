"""Pack documents into windows of fixed size, each filled to target proportions of its sources.

Every source is a queue: its documents' tokens one after the other. Deficit round-robin serves queues by credit:
a source earns credit at its target rate and, whenever it has a quantum's worth, one quantum of its queue is
due. Quanta go into windows in the order in which they fall due, so each window holds its sources in target
proportion up to a quantum a source, and what a source is short of in one window it gets in the next, across
all windows and partitions. A source that runs dry leaves its share to the others.

When a quantum falls due follows from its number in its queue alone, so the order is one distributed sort of
quanta, without a scheduler that walks the windows. A quantum divides the window, so documents are cut at
multiples of it in their queue, which each task knows from how many tokens of the source lie in earlier parts.
What is left of each queue, less than a quantum, follows behind all quanta. The last window is cut into powers
of two, so there is no padding at all.

Defined cases: a null text is empty and has the closing id alone; a null source is a source of its own; repeated
rows are documents each; ties of quanta go by source; an empty table packs nothing; a null id stays null; a very
long text is one document of many pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table, tune
from .tokens import BYTE_BPE, Distinct, byte_bpe, byte_words, gathered, slices

WINDOW, QUANTUM, CLOSE = 1024, 64, 0
#: Quanta of one row of the table that unfolds into them, and of one range of their order.
RUN, RANGE_ROWS = 100_000, 1_000_000
#: Rows of the table of queues and parts; a larger one meets the documents in a shuffle.
BROADCAST_PARTS = 200_000


def width(tokenizer: str) -> type:
    return np.uint16 if byte_bpe(tokenizer).get_vocab_size() <= 1 << 16 else np.uint32


def queue_of(source: Column) -> Column:
    """The name of a source's queue; that of null is empty and goes last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tokenised(docs: DataFrame, tokenizer: str, close: int) -> DataFrame:
    """(part, doc_id, queue, before, n, ids): tokens of each document, and how many of its queue come before it in its part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far, kind = TaskContext.get().partitionId(), {}, width(tokenizer)
        for batch in slices(batches):
            d = Distinct(batch.column("text"), first=True)
            known, size = byte_words(d.spaced(), tokenizer)
            n = d.sums(size) + 1
            ends = np.cumsum(n)
            ids = np.full(int(ends[-1]), close, kind)
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            word = d.at[gathered(d.begin, d.n)]
            ids[inner] = known[gathered((np.cumsum(size) - size)[word], size[word])]
            each = ids.itemsize * np.concatenate(([0], ends))
            data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(each), pa.py_buffer(ids)]).cast(pa.binary())
            before = []
            for q, k in zip(batch.column("queue").to_pylist(), n.tolist()):
                before.append(so_far.get(q, 0))
                so_far[q] = before[-1] + k
            cols = [pa.array([part] * len(batch), pa.int32()), batch.column("doc_id"), batch.column("queue"), pa.array(before, pa.int64()), pa.array(n), data]
            yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "queue", "before", "n", "ids"])

    rows = docs.select("doc_id", queue_of(F.col("source")).alias("queue"), "text")
    return rows.mapInArrow(run, f"part int, doc_id {kind}, queue string, before long, n long, ids binary")


def powers(rest: int) -> list[int]:
    """Where the powers of two that make up ``rest`` begin, the largest first, and the end."""
    out = [0]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(out[-1] + (1 << bit))
    return out


def ordered(queues: DataFrame, quantum: int, scratch: Scratch) -> DataFrame:
    """(queue, j, place): all quanta in the order in which they fall due. ``queues`` has queue, quanta and rate, its share of what is served.

    A sort by ranges and the offsets of ranges; a queue of many quanta unfolds in runs that lie in different tasks.
    """
    runs = queues.where("quanta > 0").select("queue", "quanta", "rate", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(quanta - 1) div {RUN}"))).alias("run"))
    runs = runs.repartition("queue", "run")
    each = runs.select("queue", "rate", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("quanta")) - 1)).alias("j"))
    each = each.select("queue", "j", ((F.col("j") + 0.5) / F.col("rate")).alias("due"))
    n = queues.agg(F.coalesce(F.sum("quanta"), F.lit(0))).first()[0]
    order = ["due", "queue", "j"]
    parts = max(1, -(-n // RANGE_ROWS), each.sparkSession.sparkContext.defaultParallelism if n > 100_000 else 1)
    rows = each.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("queue", "j", F.monotonically_increasing_id().alias("at"))
    rows = scratch.keep(rows.withColumn("part", F.shiftright("at", 33)), "quanta")
    before = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    return rows.join(F.broadcast(before.select("part", "before")), "part").select("queue", "j", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def pieces(rows: DataFrame, window: int, quantum: int, total: int) -> DataFrame:
    """Pieces of documents (start, length, ids_crc32) with the quantum j of their queue and their offset in it, or, behind all quanta, j null and their place in the whole."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    edges = np.array(powers(total % window), np.int64) + total // window * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            first, n, full, tail = get("first"), get("n"), get("quanta") * quantum, get("tail")
            last = first + n
            # Edges of quanta inside, the queue's last quantum, and edges of windows behind it.
            inside = np.maximum(0, np.minimum(last - 1, full) // quantum - first // quantum)
            doc = np.repeat(np.arange(len(n)), inside)
            cuts = (first // quantum)[doc] + 1 + np.arange(len(doc)) - np.repeat(np.cumsum(inside) - inside, inside)
            doc, cuts = [np.arange(len(n)), doc], [first, cuts * quantum]
            for i in np.flatnonzero(last > full).tolist():
                a, b = tail[i], tail[i] + last[i] - full[i]
                own = np.concatenate((np.arange(a // window + 1, b // window + 1) * window, edges))
                own = np.unique(own[(own > a) & (own < b)]) - a + full[i]
                own = own[own > first[i]]
                doc.append(np.full(len(own), i))
                cuts.append(own)
            doc, cuts = np.concatenate(doc), np.concatenate(cuts)
            order = np.lexsort((cuts, doc))
            doc, cuts = doc[order], cuts[order]
            end = np.where(np.append(doc[1:] != doc[:-1], True), last[doc], np.append(cuts[1:], 0))
            start = cuts - first[doc]
            size = end - cuts
            data = [np.frombuffer(x, np.uint8) for x in batch.column("ids").to_pylist()]
            wide = [x.view(np.uint16 if len(x) == 2 * k else np.uint32).astype("<u4") for x, k in zip(data, n.tolist())]
            crc = [zlib.crc32(wide[d][s : s + k]) for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist())]
            behind = cuts >= full[doc]
            cols = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), batch.column("queue").take(pa.array(doc)),
                pa.array(cuts // quantum, mask=behind), pa.array(np.where(behind, tail[doc] + cuts - full[doc], cuts % quantum)),
            ]
            for i in range(0, len(doc), 50_000):
                yield pa.RecordBatch.from_arrays([c[i : i + 50_000] for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "queue", "j", "at"])

    return rows.select("doc_id", "queue", "first", "n", "quanta", "tail", "ids").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, queue string, j long, at long")


def pack(
    spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, window: int = WINDOW, quantum: int = QUANTUM, tokenizer: str = BYTE_BPE, close: int = CLOSE, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source): the pieces of all documents (doc_id, text, source).

    ``weights`` (source, weight: above 0) are the target proportions; sources without one, or all by default, weigh as
    many tokens as they have, so that all queues end together. ``quantum`` divides ``window``, a power of two.
    """
    if window & (window - 1) or quantum & (quantum - 1) or quantum > window:
        raise ValueError("window and quantum are powers of two, the quantum at most the window")
    tune(spark)
    scratch = scratch or Scratch(spark, "packing")
    rows = scratch.keep(tokenised(docs, tokenizer, close), "tokens")
    parts = scratch.keep(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "parts")
    queues = parts.groupBy("queue").agg(F.sum("n").alias("tokens"))
    if weights is not None:
        own = weights.groupBy(queue_of(F.col("source")).alias("queue")).agg(F.max("weight").cast("double").alias("weight"))
        queues = queues.join(own, "queue", "left")
    else:
        queues = queues.withColumn("weight", F.lit(None).cast("double"))
    rate = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("tokens").cast("double"))
    queues = scratch.keep(queues.select("queue", "tokens", rate.alias("rate"), F.expr(f"tokens div {quantum}").alias("quanta")), "queues")
    total, served = queues.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.col("quanta") * quantum), F.lit(0))).first()
    rests = behind(queues.select("queue", (F.col("tokens") - F.col("quanta") * quantum).alias("rest")), served, scratch)
    # A queue has one row a part, so this window is bounded by the number of parts.
    first = F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = parts.withColumn("base", F.coalesce(first, F.lit(0))).join(queues.select("queue", "quanta"), "queue").join(rests, "queue").select("queue", "part", "base", "quanta", "tail")
    if parts.count() <= BROADCAST_PARTS:
        base = F.broadcast(base)
    rows = rows.join(base, ["queue", "part"]).withColumn("first", F.col("base") + F.col("before"))
    cut = scratch.keep(pieces(rows, window, quantum, total), "pieces")
    placed = cut.where("j is not null").join(ordered(queues, quantum, scratch), ["queue", "j"]).withColumn("at", F.col("place") * quantum + F.col("at")).drop("place")
    every = placed.select(*cut.columns).unionByName(cut.where("j is null"))
    whole, edges = total // window, powers(total % window)
    sequence, offset = F.expr(f"at div {window}"), F.col("at") % window
    for i, edge in enumerate(edges[:-1]):
        here = F.col("at") >= whole * window + edge
        sequence, offset = F.when(here, F.lit(whole + i)).otherwise(sequence), F.when(here, F.col("at") - (whole * window + edge)).otherwise(offset)
    source = F.when(F.col("queue") != "", F.substring("queue", 2, 1 << 30))
    return every.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), source.alias("source"))


def behind(rests: DataFrame, served: int, scratch: Scratch) -> DataFrame:
    """(queue, tail): where the rest of each queue begins in the whole, one rest after the other."""
    order = ["queue"]
    n = rests.count()
    rows = rests.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("part", F.shiftright("at", 33)), "rests")
    sizes = rows.groupBy("part").agg(F.sum("rest").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    # A range holds at most RANGE_ROWS rows or so.
    own = F.coalesce(F.sum("rest").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("own", own).join(F.broadcast(sizes.select("part", "before")), "part").select("queue", (F.col("before") + F.col("own") + served).alias("tail"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))

"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of rows of one task, bounded in bytes and words. Its text is the sequence of word numbers
of the benchmark's vocabulary; a word outside it cannot lie in an occurrence and becomes a separator, and
stretches shorter than the shortest window are left out. Separators differ from each other, so suffixes
compare within a stretch only. The index is the Burrows-Wheeler transform in a wavelet matrix with ranks,
plus the suffix positions at every eighth word and at starts of stretches.

All windows are searched backwards at once, a word a step, by wavelet ranks; the rows of the intervals that
remain are walked back to a sampled position. Occurrences become word spans, merged per text; the spans
can be cut from the text. The benchmark is taken in blocks of bounded size, one pass each.

Defined cases: a null text has no words; an item without words, or without an id, is not searched; an item
of fewer words than a window is one window; repeated items and rows are handled each; an empty benchmark
finds nothing; a column named ``leak`` is replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, tune
from .kernel import U, byte_table, lowered, segment_hashes, texts, word_bounds

#: Bytes below 128 that part words, once A-Z is lower-cased.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
SHARD_BYTES, SHARD_WORDS = 24 << 20, 1 << 20
SAMPLE = 8
#: Words of the benchmark that one pass searches.
BLOCK_WORDS = 2_000_000
LEAK = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Windows:
    """The distinct windows of a block of items: their words as numbers from 1, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        space, rows = byte_table(SEPARATORS), {}
        for _, offsets, data in texts(pa.array([t for _, t in items], pa.string()), 1 << 60):
            data = lowered(data)
            starts, ends, bounds = word_bounds(data, offsets, space)
            hashes = segment_hashes(data, starts, ends)
            for (item, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
                n = min(size, b - a)
                for at in range(a, b - n + 1 if n else a):
                    rows.setdefault(hashes[at : at + n].tobytes(), set()).add(item)
        words = [np.frombuffer(k, U) for k in rows]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, U)
        self.shortest = min(map(len, words), default=size)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.words = np.zeros((len(words), size), np.int64)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = np.searchsorted(self.vocabulary, w) + 1
        self.items = [sorted(x) for x in rows.values()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of distinct separators (0) and words (from 1) in order, by doubling the compared length."""
    n = len(symbols)
    gap = symbols == 0
    value = np.where(gap, np.cumsum(gap) - 1, symbols + gap.sum())
    order = np.argsort(value, kind="stable")
    ranked = np.empty(n, np.int64)
    sorted_ = value[order]
    # The rank of a suffix is the first place of its group, so that ranks stay right while groups split.
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    ranked[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = 1
    open_ = order[~(new & np.concatenate((new[1:], [True])))]
    while len(open_):
        # Only suffixes that still share their rank are sorted again, by the rank of what follows.
        after = np.where(open_ + length < n, ranked[np.minimum(open_ + length, n - 1)] + 1, 0)
        by = np.lexsort((after, ranked[open_]))
        open_, after = open_[by], after[by]
        group = ranked[open_]
        start = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(open_)) - np.maximum.accumulate(np.where(start, np.arange(len(open_)), 0)) + group
        order[place] = open_
        split = start | np.concatenate(([True], after[1:] != after[:-1]))
        ranked[open_] = np.maximum.accumulate(np.where(split, place, 0))
        open_ = open_[~(split & np.concatenate((split[1:], [True])))]
        length *= 2
    return order


class FMIndex:
    """Search and locate in a sequence of symbols: 0 parts stretches, words count from 1."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        sa = suffix_array(symbols)
        before = np.where(sa > 0, symbols[sa - 1], 0)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (before >> bit & 1).astype(bool)
            ones = np.concatenate(([0], np.cumsum(one, dtype=np.int32)))
            self.levels.append((bit, len(one) - int(ones[-1]), ones, one))
            before = np.concatenate((before[~one], before[one]))
        self.base = self.down(np.arange(top + 1), np.zeros(top + 1, np.int64))
        sampled = (sa % SAMPLE == 0) | (np.where(sa > 0, symbols[sa - 1], 0) == 0)
        self.sampled, self.positions = sampled, sa[sampled]
        self.sampled_before = np.cumsum(sampled) - 1

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the i-th place lies among the places of ``symbol`` on the last level."""
        for bit, zeros, ones, _ in self.levels:
            up = ones[i]
            i = np.where(symbol >> bit & 1, zeros + up, i - up)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.down(symbol, i) - self.base[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer."""
        symbol, i = np.zeros(len(row), np.int64), row
        for bit, zeros, ones, one in self.levels:
            up, hit = ones[i], one[i]
            symbol |= hit.astype(np.int64) << bit
            i = np.where(hit, zeros + up, i - up)
        return self.first[symbol] + i - self.base[symbol]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high) of the windows that occur, as intervals of rows."""
        window = np.flatnonzero(lengths > 0)
        last = words[window, lengths[window] - 1]
        low, high = self.first[last], self.first[last + 1]
        step = 1
        while True:
            keep = low < high
            window, low, high = window[keep], low[keep], high[keep]
            more = lengths[window] > step
            if not more.any():
                return window, low, high
            symbol = words[window[more], lengths[window[more]] - 1 - step]
            low[more] = self.first[symbol] + self.rank(symbol, low[more])
            high[more] = self.first[symbol] + self.rank(symbol, high[more])
            step += 1

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, todo, walked = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        row = row.copy()
        while len(todo):
            hit = self.sampled[row]
            out[todo[hit]] = self.positions[self.sampled_before[row[hit]]] + walked
            todo, row = todo[~hit], row[~hit]
            row = self.back(row) if len(row) else row
            walked += 1
        return out


class Shard:
    """Rows gathered until they are indexed: their stretches of known words, and where each lies."""

    def __init__(self, windows: Windows) -> None:
        self.w = windows
        self.batches: list[pa.RecordBatch] = []
        self.counts: list[int] = []
        self.symbols, self.row, self.at = [], [], []
        self.bytes = self.words = 0
        self.space = byte_table(SEPARATORS)

    def add(self, batch: pa.RecordBatch) -> None:
        base = len(self.counts)
        self.batches.append(batch)
        for first, offsets, data in texts(batch.column("text")):
            data = lowered(data)
            starts, ends, bounds = word_bounds(data, offsets, self.space)
            self.counts += np.diff(bounds).tolist()
            self.bytes += len(data)
            if not len(starts):
                continue
            number = self.w.numbers(segment_hashes(data, starts, ends))
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            known = number > 0
            # Stretches of known words within a text, at least as long as the shortest window.
            begin = known & np.concatenate(([True], ~known[:-1] | (text[1:] != text[:-1])))
            stretch = np.cumsum(begin)[known]
            if not len(stretch):
                continue
            size = np.bincount(stretch)
            place = np.flatnonzero(known)[size[stretch] >= self.w.shortest]
            stretch = stretch[size[stretch] >= self.w.shortest]
            if not len(place):
                continue
            # A separator goes before each stretch.
            head = np.concatenate(([True], stretch[1:] != stretch[:-1]))
            to = np.arange(len(place)) + np.cumsum(head)
            room = to[-1] + 1
            symbols, row, at = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
            symbols[to], row[to], at[to] = number[place], base + first + text[place], place - bounds[text[place]]
            self.symbols.append(symbols), self.row.append(row), self.at.append(at)
            self.words += room

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.words >= SHARD_WORDS

    def found(self) -> dict[int, tuple[list, set]]:
        """Row -> (spans of words, items) of all rows with an occurrence."""
        if not self.symbols or not len(self.w.lengths):
            return {}
        symbols = np.concatenate([*self.symbols, [0]])
        row, at = np.concatenate(self.row), np.concatenate(self.at)
        index = FMIndex(symbols, len(self.w.vocabulary))
        window, low, high = index.search(self.w.words, self.w.lengths)
        if not len(window):
            return {}
        many = high - low
        each = np.repeat(window, many)
        rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        position = index.locate(rows)
        out: dict[int, tuple[list, set]] = {}
        for r, a, w in sorted(zip(row[position].tolist(), at[position].tolist(), each.tolist(), strict=True)):
            spans, items = out.setdefault(r, ([], set()))
            spans.append((a, a + int(self.w.lengths[w]) - 1))
            items.update(self.w.items[w])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


LEAK_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))]
)


def searcher(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(shard: Shard) -> Iterator[pa.RecordBatch]:
        found, base = shard.found(), 0
        for b in shard.batches:
            old = b.column("leak").to_pylist()
            leak = []
            for i in range(len(b)):
                spans, items = found.get(base + i, ((), ()))
                if old[i]:
                    spans, items = [*spans, *((x["first"], x["last"]) for x in old[i]["spans"])], {*items, *old[i]["items"]}
                leak.append({"n_words": shard.counts[base + i], "spans": [{"first": x, "last": y} for x, y in merged(list(spans))], "items": sorted(items)})
            base += len(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "leak"), pa.array(leak, LEAK_ARROW)], [*(c for c in b.schema.names if c != "leak"), "leak"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(windows)
        for b in batches:
            shard.add(b)
            if shard.full():
                yield from flush(shard)
                shard = Shard(windows)
        yield from flush(shard)

    return run


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (text, ...) with ``leak``: its words, the merged spans of words that occur in items, and these items' ids as text.

    A benchmark of more than ``block_words`` words is searched in blocks. The result of each block is written
    before the next one is read, so the driver and the tasks hold one block's windows at a time.
    """
    tune(spark)
    scratch = Scratch(spark, "leaks")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    words = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    blocks = max(1, -(-(items.agg(F.sum(words)).first()[0] or 0) // block_words))
    out = docs.withColumn("leak", F.lit(None).cast(LEAK))
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        old, out = out, out.mapInArrow(searcher(Windows([tuple(r) for r in part.collect()], window)), out.schema)
        if i < blocks - 1:
            out = scratch.keep(out, "block")
            if i:
                scratch.drop(old)
    return out


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def without_spans(docs: DataFrame) -> DataFrame:
    """Cut the spans of ``leak`` from ``text``: from the first word's start to the last word's end."""

    def run(batches):
        space = byte_table(SEPARATORS)
        for b in batches:
            text, leak = b.column("text").to_pylist(), b.column("leak").to_pylist()
            for i, x in enumerate(leak):
                if not x or not x["spans"]:
                    continue
                raw = text[i].encode()
                data = lowered(np.frombuffer(raw, np.uint8))
                starts, ends, _ = word_bounds(data, np.array([0, len(data)]), space)
                kept, at = [], 0
                for s in x["spans"]:
                    kept.append(raw[at : starts[s["first"]]])
                    at = ends[s["last"]]
                text[i] = b"".join([*kept, raw[at:]]).decode()
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(spark, docs, table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("leak.spans"))
    ids = F.array_join(F.array_sort("leak.items"), ",")
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

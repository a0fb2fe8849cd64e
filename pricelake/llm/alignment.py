"""Align the tokens of two tokenizers over the same bytes.

A document is a sequence of groups: stretches of bytes between places where tokens of both sides end. What is
known of any stretch of it is a ``Fragment``: the tokens before its first common end (open prefix), the closed
groups up to its last common end, and the tokens after it (open suffix). ``joined`` composes neighbours and is
associative, with ``EMPTY`` as its unit, so fragments may be composed in any tree.

Long documents are cut into byte ranges. Either side is cut at a place of its own, the next one where its
tokenizer is known to begin anew; the ranges are encoded in different tasks, and a tree of grouped reductions
composes them. Shorter documents are one range each and never leave their task; there the fragments of
distinct words, which begin and end at common ends, are made once and looked up.

How often a pair of ids is linked in the corpus is counted by words in each task and summed by pair. Sums over
a document's links then take that table block by block, each small enough to send to all tasks.

Defined cases: a text that is null, empty, or not given back byte by byte by both tokenizers has no tokens; a
null id stays null; repeated rows are rows, and their links count each time; an empty table gives no rows; very
long texts are cut as above (a run without any cut is one range); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tune
from .tokens import BYTE_BPE, MARK, PIECE_BPE, Distinct, byte_sizes, byte_tokens, byte_words, bytes_of, data_of, gathered, piece_pairs, piece_tokens, piece_words, pieces_of, sizes_of, slices, sums, text_ids

#: Characters of a range of a long document, fragments of one composition, pairs of one block.
RANGE, FAN, BLOCK = 1 << 15, 8, 6_000_000
OUT = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side(NamedTuple):
    """Tokens of one side in order: ids and the byte offsets where they end."""

    ids: np.ndarray
    ends: np.ndarray

    def then(self, other: Side) -> Side:
        return Side(np.concatenate((self.ids, other.ids)), np.concatenate((self.ends, other.ends)))

    def cut(self, end: int) -> tuple[Side, Side]:
        at = int(np.searchsorted(self.ends, end, "right"))
        return Side(self.ids[:at], self.ends[:at]), Side(self.ids[at:], self.ends[at:])


NONE = Side(np.zeros(0, np.int64), np.zeros(0, np.int64))


class Fragment(NamedTuple):
    """``cut``: whether a common end is known. Without one all tokens lie in the suffix."""

    cut: bool = False
    head: tuple[Side, Side] = (NONE, NONE)
    groups: str = ""
    n: tuple[int, int, int, int] = (0, 0, 0, 0)  # tokens of both sides, groups, links, all of closed groups
    codes: np.ndarray = NONE.ids
    times: np.ndarray = NONE.ids
    tail: tuple[Side, Side] = (NONE, NONE)


EMPTY = Fragment()
#: What is before a document: a common end.
START = Fragment(cut=True)


def both_ends(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Common ends, and all ends."""
    ends = np.concatenate((a.ends, b.ends))
    ends.sort(kind="stable")
    new = np.append(True, ends[1:] != ends[:-1])[: len(ends)]
    return ends[~new], ends[new]


def links(a: Side, b: Side, ends: np.ndarray | None = None) -> np.ndarray:
    """Codes (a's id, b's id) of all pairs that overlap: one for each stretch between neighbouring ends of either side."""
    ends = both_ends(a, b)[1] if ends is None else ends
    return (a.ids[np.searchsorted(a.ends, ends)] << 32) | b.ids[np.searchsorted(b.ends, ends)]


_TEXT: list[np.ndarray] = []


def texts_of(ids: np.ndarray, last: np.ndarray, stop: str) -> np.ndarray:
    """Decimal ids, each with a comma behind it, or with ``stop`` where it is the last."""
    if not _TEXT or len(_TEXT[0]) <= ids.max(initial=0):
        _TEXT[:] = [np.array([f"{i}{end}" for i in range(max(1 << 16, 2 * int(ids.max(initial=0))))], object) for end in ",|;"]
    return np.where(last, _TEXT[",|;".index(stop)][ids], _TEXT[0][ids])


def group_text(a: Side, b: Side, common: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` of tokens whose groups end at ``common``."""
    ga, gb = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
    last = lambda g: np.append(g[1:] != g[:-1], True)
    text = np.concatenate((texts_of(a.ids, last(ga), "|"), texts_of(b.ids, last(gb), ";")))
    order = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
    return "".join(text[order].tolist())[:-1]


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, times
    order = np.argsort(codes)
    codes = codes[order]
    begin = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[begin], np.add.reduceat(times[order], begin)


def fragment(a: Side, b: Side, closed: bool = False) -> Fragment:
    """The fragment of neighbouring tokens; ``closed``: a common end lies right before them."""
    common = both_ends(a, b)[0]
    if not len(common):
        return Fragment(closed, tail=(a, b))
    head = (NONE, NONE)
    if not closed:
        (ha, a), (hb, b) = a.cut(common[0]), b.cut(common[0])
        head, common = (ha, hb), common[1:]
    if not len(common):
        return Fragment(True, head, tail=(a, b))
    (a, ta), (b, tb) = a.cut(common[-1]), b.cut(common[-1])
    code = links(a, b)
    return Fragment(True, head, group_text(a, b, common), (len(a.ids), len(b.ids), len(common), len(code)), *summed(code, np.ones(len(code), np.int64)), (ta, tb))


def joined(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbours. Between the last common end of x and the first of y groups may close, also at ends of which each knew one side."""
    first = y.head if y.cut else y.tail
    middle = fragment(x.tail[0].then(first[0]), x.tail[1].then(first[1]), closed=x.cut)
    parts = [p for p in ((x if x.cut else None), middle, (y if y.cut else None)) if p is not None]
    closed = [p for p in parts if p.n[2]]
    codes, times = summed(np.concatenate([p.codes for p in parts]), np.concatenate([p.times for p in parts])) if closed else (NONE.ids, NONE.ids)
    return Fragment(
        x.cut or y.cut or middle.cut,
        x.head if x.cut else middle.head,
        ";".join(p.groups for p in closed),
        tuple(sum(p.n[i] for p in parts) for i in range(4)),
        codes,
        times,
        y.tail if y.cut else middle.tail,
    )




_PLACE_A = re.compile("(?<=\\S)(?=[ \\n\\t\\r])|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[，。、！？；：])")


def place_a(text: str, start: int) -> int:
    """The first place from ``start`` where a word of the byte-level tokenizer begins whatever stands before: white space after something else, or a mark after a letter."""
    found = _PLACE_A.search(text, start) if start else None
    return found.start() if found else len(text) if start else 0


def place_b(text: str, start: int, pairs: frozenset[str]) -> int:
    """The first place from ``start`` between two characters that no piece holds together."""
    i = start
    while 0 < i < len(text) and text[i - 1 : i + 1].replace(" ", MARK) in pairs:
        i += 1
    return i


def ranges(text: str, size: int, pairs: frozenset[str]) -> list[tuple[str, int, str, int]]:
    """(text and first byte) of both sides for each range of about ``size`` characters."""
    at = range(0, len(text), size)
    a, b = [*(place_a(text, i) for i in at), len(text)], [*(place_b(text, i, pairs) for i in at), len(text)]
    byte = {0: 0}
    for last, this in zip(c := sorted({0, *a, *b}), c[1:]):
        byte[this] = byte[last] + len(text[last:this].encode())
    return [(text[a[k] : a[k + 1]], byte[a[k]], text[b[k] : b[k + 1]], byte[b[k]]) for k in range(len(at))]


@dataclass(frozen=True)
class Pair:
    """Both tokenizers, by the paths of their files."""

    a: str = BYTE_BPE
    b: str = PIECE_BPE

    def sides(self, text_a: str, byte_a: int, text_b: str, byte_b: int) -> tuple[Side, Side] | None:
        """Tokens of a range, or None where a side does not give back its text."""
        out = []
        for text, begin, ids, tokens, sizes in (
            (text_a, byte_a, text_ids(text_a, self.a), byte_tokens(self.a), sizes_of("a", self.a)),
            (text_b, byte_b, pieces_of([text_b], self.b)[0], piece_tokens(self.b), sizes_of("b", self.b)),
        ):
            if b"".join(map(tokens.__getitem__, ids)) != text.encode():
                return None
            ids = np.array(ids, np.int64)
            out.append(Side(ids, begin + np.cumsum(sizes[ids])))
        return out[0], out[1]


class Lexicon:
    """Closed fragments of words, each with the space before it: numbers of tokens, groups and links, their text, and the links' codes."""

    def __init__(self, spaced: pa.Array, pair: Pair, text: bool = True) -> None:
        length, data = byte_sizes(spaced), data_of(spaced)
        found, bad = [], np.zeros(len(spaced), bool)
        for side, name, (ids, n) in (("a", pair.a, byte_words(spaced, pair.a)), ("b", pair.b, piece_words(spaced, pair.b))):
            sizes = sizes_of(side, name)
            if not np.array_equal(sums(sizes[ids], np.concatenate(([0], np.cumsum(n)))), length) or not np.array_equal(bytes_of(ids, side, name), data):
                at = np.concatenate(([0], np.cumsum(n))).tolist()
                bad |= np.array([bytes_of(ids[i:j], side, name).tobytes().decode(errors="replace") != w for w, i, j in zip(spaced.to_pylist(), at, at[1:])], bool)
            found.append((ids, n, sizes))
        words = len(spaced)
        self.bad, self.n = bad, np.zeros((4, words), np.int64)  # tokens of both sides, groups, links
        good = np.flatnonzero(~bad)
        # All words one after the other: their ends are common ends, so they are one closed fragment.
        a, b = (Side(ids, np.cumsum(sizes[ids])) for ids, sizes in ((ids[np.repeat(~bad, n)], sizes) for ids, n, sizes in found))
        bounds = np.concatenate(([0], np.cumsum(length[good])))
        common, every = both_ends(a, b)
        for k, ends in enumerate((a.ends, b.ends, common, every)):
            self.n[k, good] = np.diff(np.searchsorted(ends, bounds, "right"))
        self.codes = links(a, b, every)
        self.text = [""] * words
        if text and len(good):
            groups = group_text(a, b, common).split(";")
            at = np.concatenate(([0], np.cumsum(self.n[2, good]))).tolist()
            for w, i, j in zip(good.tolist(), at, at[1:]):
                self.text[w] = ";".join(groups[i:j])

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of links over each word's links."""
        return sums(values, np.concatenate(([0], np.cumsum(self.n[3]))))


def counted(code: np.ndarray, block: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, value = block
    if not len(known) or not len(code):
        return np.zeros((2, len(code)), np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    v = np.where(known[at] == code, value[at], 0)
    return v >> 1, v & 1


def short(text: F.Column, size: int) -> F.Column:
    return F.coalesce(F.length(text), F.lit(0)) <= size


def pair_counts_of_words(docs: DataFrame, pair: Pair) -> DataFrame:
    """(code, n): how often each pair of ids is linked in these documents, by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            d = Distinct(batch.column("text"))
            lexicon = Lexicon(d.spaced(), pair, text=False)
            good = d.sums(lexicon.bad) == 0
            times = np.bincount(d.at[gathered(d.begin[good], d.n[good])], minlength=len(d.words))
            codes, total = summed(lexicon.codes, np.repeat(times, lexicon.n[3]))
            seen = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(codes[seen]), pa.array(total[seen])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long")


def aligned_words(docs: DataFrame, pair: Pair, block) -> DataFrame:
    """The result's columns for documents that are one range each; sums hold what the block of pairs (a broadcast of codes and values) has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            d = Distinct(batch.column("text"))
            lexicon = Lexicon(d.spaced(), pair)
            count, best = counted(lexicon.codes, block.value)
            none = (d.sums(lexicon.bad) > 0) | (d.n == 0)
            n = [np.where(none, 0, d.sums(x)) for x in (*lexicon.n, lexicon.per_word(best), lexicon.per_word(count))]
            text, word = lexicon.text, d.at.tolist()
            digest = ["" if no else sha256(";".join([text[w] for w in word[i : i + k]])) for no, i, k in zip(none.tolist(), d.begin.tolist(), d.n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, n), pa.array(digest, pa.string())], ["doc_id", *fields, "groups_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT.format(id=kind))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


FRAGMENT = "key long, k long, bad boolean, cut boolean, groups string, n array<long>, codes array<long>, times array<long>, " + ", ".join(
    f"{part}_{s}_{x} array<long>" for part in ("head", "tail") for s in "ab" for x in ("ids", "ends")
)


def row_of(key: int, k: int, f: Fragment | None) -> tuple:
    g = f or EMPTY
    return (key, k, f is None, g.cut, g.groups, list(g.n), g.codes, g.times, *(x for part in (g.head, g.tail) for s in part for x in (s.ids, s.ends)))


def fragment_of(row) -> Fragment | None:
    if row.bad:
        return None
    part = lambda p: tuple(Side(np.asarray(getattr(row, f"{p}_{s}_ids"), np.int64), np.asarray(getattr(row, f"{p}_{s}_ends"), np.int64)) for s in "ab")
    return Fragment(bool(row.cut), part("head"), row.groups, tuple(int(x) for x in row.n), np.asarray(row.codes, np.int64), np.asarray(row.times, np.int64), part("tail"))


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FRAGMENT.split(", ")])


def long_documents(docs: DataFrame, pair: Pair, size: int, scratch: Scratch) -> DataFrame:
    """Closed documents (doc_id and a fragment's columns) of texts longer than a range: cut, encoded and composed in a tree."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = piece_pairs(pair.b)
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                parts = ranges(" " + text, size, pairs)
                yield pd.DataFrame([(key, k, len(parts), *p) for k, p in enumerate(parts)], columns=["key", "k", "parts", "a", "a_at", "b", "b_at"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = pair.sides(r.a, r.a_at, r.b, r.b_at)
                f = fragment(*found) if found else None
                yield frame([row_of(r.key, r.k, joined(START, f) if f and not r.k else f)])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = EMPTY
        for r in pdf.sort_values("k").itertuples():
            f = fragment_of(r)
            out = joined(out, f) if f is not None and out is not None else None
        return frame([row_of(int(pdf["key"].iloc[0]), int(pdf["k"].min()) // FAN, out)])

    rows = scratch.keep(docs.where(~short(F.col("text"), size)).select("doc_id", "text").withColumn("key", F.monotonically_increasing_id()), "long")
    pieces = scratch.keep(rows.select("key", "text").mapInPandas(cut, "key long, k long, parts long, a string, a_at long, b string, b_at long"), "ranges")
    most = pieces.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
    level = scratch.keep(pieces.drop("parts").repartition("key", "k").mapInPandas(encode, FRAGMENT), "fragments")
    while most > 1:
        level = scratch.keep(level.groupBy("key", F.floor(F.col("k") / FAN)).applyInPandas(compose, FRAGMENT), "composed")
        most = -(-most // FAN)
    return rows.select("key", F.col("doc_id").cast(kind)).join(level, "key").drop("key", "k")


def aligned_long(closed: DataFrame, block) -> DataFrame:
    """The result's columns of closed documents."""
    kind = closed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["doc_id", "bad", "groups", "n", "codes", "times"]).to_pylist():
                if r["bad"]:
                    out.append((r["doc_id"], 0, 0, 0, 0, 0, 0, ""))
                    continue
                times = np.array(r["times"], np.int64)
                count, best = counted(np.array(r["codes"], np.int64), block.value)
                out.append((r["doc_id"], *r["n"], int(best @ times), int(count @ times), sha256(r["groups"])))
            names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string())], ["doc_id", *names, "groups_sha256"])

    return closed.mapInArrow(run, OUT.format(id=kind))


def pair_table(docs: DataFrame, closed: DataFrame, pair: Pair, size: int, scratch: Scratch) -> DataFrame:
    """(a, b, n, best): ids linked anywhere, how often, and whether no other id of the first side is linked to b more often."""
    parts = pair_counts_of_words(docs.where(short(F.col("text"), size)), pair)
    more = closed.where("not bad").select(F.explode(F.arrays_zip("codes", "times")).alias("z")).select(F.col("z.codes").alias("code"), F.col("z.times").alias("n"))
    total = scratch.keep(parts.unionByName(more).groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    most = total.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = total.withColumn("b", b).join(most, "b").select(F.shiftright("code", 32).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"), "code")
    return scratch.keep(out, "best")


def align(spark: SparkSession, docs: DataFrame, pair: Pair = Pair(), size: int = RANGE, block: int = BLOCK, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the columns of OUT for each row of ``docs`` (doc_id, text), and the table of linked ids."""
    tune(spark)
    scratch = scratch or Scratch(spark, "alignment")
    docs = docs.select("doc_id", "text")
    closed = scratch.keep(long_documents(docs, pair, size, scratch), "closed")
    pairs = pair_table(docs, closed, pair, size, scratch)
    n = max(1, -(-pairs.count() // block))
    out = None
    for i in range(n):
        # A block of pairs is bounded; documents take their sums from one after the other.
        part = pairs.where(F.pmod(F.xxhash64("code"), F.lit(n)) == i).select("code", (F.col("n") * 2 + F.col("best").cast("long")).alias("v")).toArrow()
        code, value = (part.column(c).to_numpy() for c in ("code", "v"))
        order = np.argsort(code)
        held = spark.sparkContext.broadcast((code[order], value[order]))
        each = aligned_words(docs.where(short(F.col("text"), size)), pair, held).unionByName(aligned_long(closed, held))
        each = each if n == 1 else scratch.keep(each, "sums")
        out = each if out is None else out.unionByName(each)
    if n > 1:
        same = [c for c in out.columns if c not in ("n_best", "count_sum")]
        # Rows that agree in all these have the same tokens, so each has an equal share of their sums.
        out = out.groupBy(*same).agg(F.sum("n_best").alias("best"), F.sum("count_sum").alias("sum"), (F.count("*") / n).cast("long").alias("rows"))
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        out = out.select("*", F.expr("best div rows").alias("n_best"), F.expr("sum div rows").alias("count_sum"))
        out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return out, pairs.drop("code")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, table(spark, sf_dir, "documents"))[0]


def brute_force(texts: list[str | None]) -> list[tuple]:
    """The contract in plain Python over whole texts."""
    from .tokens import byte_bpe, piece_bpe

    ta, tb, per, count = byte_tokens(), piece_tokens(), [], {}
    for text in texts:
        found = None
        if text:
            ids = [byte_bpe().encode(" " + text, add_special_tokens=False).ids, piece_bpe().encode(text)]
            if all(b"".join(t[i] for i in x) == (" " + text).encode() for x, t in zip(ids, (ta, tb))):
                found = []
                for x, t in zip(ids, (ta, tb)):
                    at, rows = 0, []
                    for i in x:
                        rows.append((i, at, at := at + len(t[i])))
                    found.append(rows)
        per.append(found)
    linked = []
    for found in per:
        rows, j = [], 0
        for a, s, e in found[0] if found else []:
            while j < len(found[1]) and found[1][j][1] < e:
                if found[1][j][2] > s:
                    rows.append((a, found[1][j][0]))
                j += 1
            j = max(0, j - 1)
        linked.append(rows)
        for p in rows:
            count[p] = count.get(p, 0) + 1
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for found, rows in zip(per, linked):
        if not found:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        common = sorted({e for _, _, e in found[0]} & {e for _, _, e in found[1]})
        cut, text = 0, []
        for c in common:
            text.append("|".join(",".join(str(i) for i, s, e in x if cut < e <= c) for x in found))
            cut = c
        out.append((len(found[0]), len(found[1]), len(common), len(rows), sum(count[p] == most[p[1]] for p in rows), sum(count[p] for p in rows), sha256(";".join(text))))
    return out

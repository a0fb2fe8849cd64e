"""Jaccard join of n-gram sets by vertical partitioning.

The n-grams of all texts have one global order, that of their hashes. It is cut into K fragments, and each
set with it. Sets that differ in at most d n-grams agree in at least K - d fragments, so with K > d two
linked sets share a fragment as a whole: sets meet in the buckets (size class, fragment, hash of the set's
part in that fragment). K follows the sizes of a class, so that no cap or prefix is needed; a set joins each
larger class in which a linked set may lie. Where no more fragments than d hold any n-gram, the empty ones
count as well.

A linked pair shares not one bucket but as many as the set's fragments exceed its differences. A set with
fewer shared buckets links with nothing; any other one leaves out its most frequent buckets, one less than
it must share, so that passages which many texts hold draw no texts together. Each bucket's sets first meet
its least one, the pivot, and these pairs join the sets of a block.

Overlaps are counted by fragments everywhere: each set is cut into ``FRAGMENTS`` stretches of the global
order, a row each; one task counts what pairs share in one fragment and knows no other one; the partial
overlaps are summed per pair and the sums compared with the threshold. The pairs with pivots come first, as
many as there are kept buckets. A block whose pairs they have not all joined or all tried is open: its sets
are dealt over chunks of bounded size and every two chunks meet, for each fragment in a unit of its own. Such
a unit gives the partial overlaps of its pairs as one matrix; the sum gives a spanning forest of the links.
So a large group of near copies makes few rows, and only sets around the threshold meet in chunks.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer
words than n make one n-gram; repeated rows and equal texts are one set and lie in one component; a null id
is an id that comes before all others only if its whole component has none; a repeated id is judged by each
of its texts; texts of any length are read whole, one is one piece of work; an empty table gives an empty
result; other columns, whatever their names, are ignored. N-grams are compared by 64-bit hashes, sets are
told apart by 128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE_BYTES, Scratch, components, table, tune
from .kernel import U, byte_table, lowered, mix, segment_hashes, shingles, signed, texts, word_bounds

#: Bits of a bucket's owner that hold the size class; the others are the set's.
CLASS_BITS = 7
#: Stretches of the global order in which overlaps are counted apart.
FRAGMENTS = 4
#: A chunk of a block has about so many sets at most, and so many n-grams.
CHUNK_SETS, CHUNK_GRAMS = 512, 1 << 19
#: Shared n-grams whose columns are multiplied at once.
COLUMNS = 2048


class Classes:
    """Size classes for sets linked when 100 * intersection >= percent * union."""

    def __init__(self, percent: int, top: int = 1 << 40) -> None:
        if not 0 < percent <= 100:
            raise ValueError("percent must lie in 1 to 100")
        self.percent = percent
        self.lows: list[int] = []
        if percent == 100:  # only equal sets link
            return
        low = 1
        while self.differences(2 * low + 1) < 1:
            low += 1
        self.lows.append(low)
        while self.lows[-1] < top:
            self.lows.append(max(self.lows[-1] + 2, self.lows[-1] * 3 // 2))

    def differences(self, both: int) -> int:
        """The most n-grams in which linked sets with that sum of sizes differ."""
        return both * (100 - self.percent) // (100 + self.percent)

    def own_differences(self, size: int) -> int:
        """The most n-grams in which a set of that size differs from any linked one."""
        return self.differences(size + size * 100 // self.percent)

    def shape(self, c: int) -> tuple[int, int]:
        """(fragments, most differences) of a class."""
        d = self.differences(2 * (self.lows[c + 1] - 1))
        return d + 3 + d // 10, d

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(class, fragments, differences) of the classes that a set of that size joins."""
        first = max(0, int(np.searchsorted(self.lows, size, "right")) - 1)
        last = int(np.searchsorted(self.lows, size * 100 // self.percent, "right")) - 1
        return [(c, *self.shape(c)) for c in range(first, last + 1)]


def sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted n-gram hashes of each row) of each chunk of rows."""
    space = byte_table(SPACE_BYTES)
    for row, offsets, data in texts(batch.column("text")):
        data = lowered(data)
        starts, ends, bounds = word_bounds(data, offsets, space)
        grams, at = shingles(segment_hashes(data, starts, ends), bounds, n)
        yield row, [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def identity(grams: np.ndarray) -> bytes:
    """128 bits of a set that is not empty."""
    sums = [np.add.reduce(mix(grams + U(k)), dtype=U) + U(len(grams)) for k in (11, 17)]
    return mix(np.array(sums, U)).tobytes()


def owner(identity_: bytes, c: int) -> int:
    """64 bits of a set and a size class. Sets that share them only meet more often than they must."""
    return int(np.frombuffer(identity_[:8], np.int64)[0]) >> CLASS_BITS << CLASS_BITS | c


def fragments(grams: np.ndarray, c: int, k: int, d: int) -> tuple[np.ndarray, int]:
    """(the buckets of a set in a class of k fragments and d differences, how many of them hold n-grams)."""
    part = ((grams >> U(32)) * U(k)) >> U(32)
    first = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    held, total = part[first], np.add.reduceat(mix(grams + U(29)), first)
    full = len(held)
    if full <= d:
        empty = np.setdiff1d(np.arange(k, dtype=U), held)
        held, total = np.concatenate((held, empty)), np.concatenate((total, np.zeros(len(empty), U)))
    return signed(mix(total + mix(held + U(c << 40)))), full


PARTS = pa.struct([("owner", pa.int64()), ("need", pa.int32()), ("buckets", pa.list_(pa.int64()))])


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, parts) of each row: its set, and for each class the set's buckets.

    need is the number of buckets that any linked set must share. A set that comes again in a task has no
    parts; an empty set has neither id nor parts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        classes, seen = Classes(percent), set()
        for b in batches:
            size, ids, parts = np.zeros(len(b), np.int64), [None] * len(b), [None] * len(b)
            for row, found in sets(b, n):
                for i, grams in enumerate(found, row):
                    if not len(grams):
                        continue
                    size[i], ids[i] = len(grams), identity(grams)
                    if ids[i] in seen:
                        continue
                    seen.add(ids[i])
                    own = classes.own_differences(len(grams)) if classes.lows else 0
                    parts[i] = []
                    for c, k, d in classes.of(len(grams)):
                        keys, full = fragments(grams, c, k, d)
                        parts[i].append((owner(ids[i], c), full - own, keys))
            flat = [p for row in parts if row for p in row]
            lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([0 if r is None else len(r) for r in rows], dtype=np.int64))), pa.int32()), values)
            keys = lists([p[2] for p in flat], pa.array(np.concatenate([np.zeros(0, np.int64), *(p[2] for p in flat)])))
            each = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int32()), keys], fields=list(PARTS))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size), pa.array(ids, pa.binary()), lists(parts, each)], ["doc_id", "n_shingles", "set_id", "parts"]
            )

    schema = f"doc_id {kind}, n_shingles bigint, set_id binary, parts array<struct<owner: bigint, need: int, buckets: array<bigint>>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def blocks(spark: SparkSession, sets_: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (id, comp): sets (64 bits less the class) that may link with pivots b, and the blocks that these pairs join."""
    parts = sets_.select(F.explode("parts").alias("p")).select("p.*")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange serves the counts of buckets and the rows that they are joined with.
    rows = parts.select("owner", F.explode("buckets").alias("bucket")).repartition(spread, "bucket")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    shared = counts.where("low < high").select("bucket", "n")
    met = scratch.keep(rows.join(shared.hint("shuffle_hash"), "bucket").select("owner", "bucket", "n"), "met")
    needs = parts.groupBy("owner").agg(F.greatest(F.min("need"), F.lit(1)).alias("need"))
    held = met.groupBy("owner").agg(F.array_sort(F.collect_set(F.struct("n", "bucket"))).alias("held")).join(needs, "owner")
    rare = F.slice("held", F.lit(1), F.size("held") - F.col("need") + 1)
    kept = held.where(F.size("held") >= F.col("need")).select("owner", F.explode(rare).alias("h")).select("owner", "h.bucket")
    kept = scratch.keep(kept, "kept")
    scratch.drop(met)
    pivots = kept.groupBy("bucket").agg(F.min("owner").alias("pivot"), F.max("owner").alias("high")).where("pivot < high")
    whole = lambda c: F.shiftleft(F.shiftright(c, CLASS_BITS), CLASS_BITS)
    edges = kept.join(pivots, "bucket").select(whole("owner").alias("a"), whole("pivot").alias("b")).where("a <> b")
    # A pair is one pair whichever of the two is the pivot.
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pivots")
    out = components(spark, edges, scratch)
    scratch.drop(kept)
    return edges, out


def cut(grams: np.ndarray) -> list[bytes]:
    """The fragments of a set's sorted n-grams."""
    step = (1 << 64) // FRAGMENTS
    at = np.searchsorted(grams, np.array([step * k for k in range(1, FRAGMENTS)], U))
    return [x.tobytes() for x in np.split(grams, at)]


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """Rows (text, set_id, ...) with ``parts``, the fragments of the set's sorted 64-bit values, in place of the text; other sets' texts are left out."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in batches:
            want, grams = b.column("set_id").to_pylist(), [None] * len(b)
            for row, found in sets(b, n):
                for i, g in enumerate(found, row):
                    if len(g) and identity(g) == want[i]:
                        grams[i] = cut(g)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(grams, pa.list_(pa.binary()))], [*names, "parts"])
            yield out.filter(pa.array([g is not None for g in grams], pa.bool_()))

    schema = rows.select(*names).withColumn("parts", F.lit(None).cast("array<binary>")).schema
    return rows.mapInArrow(run, schema)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of sets a with sets b."""
    out = np.zeros((len(a), len(b)), np.int64)
    side = lambda s: (np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s]))
    (ga, ra), (gb, rb) = side(a), side(b)
    both = np.intersect1d(ga, gb)

    def known(g, r):
        at = np.minimum(np.searchsorted(both, g), max(len(both) - 1, 0))
        hit = both[at] == g if len(both) else np.zeros(len(g), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], r[hit][order]

    (ga, ra), (gb, rb) = known(ga, ra), known(gb, rb)
    for low in range(0, len(both), COLUMNS):
        cut = lambda g, r: (g[(s := slice(*np.searchsorted(g, (low, low + COLUMNS))))] - low, r[s])  # noqa: E731, B023
        (fa, xa), (fb, xb) = cut(ga, ra), cut(gb, rb)
        size_a, size_b = np.bincount(fa, minlength=COLUMNS), np.bincount(fb, minlength=COLUMNS)
        if (size_a * size_b).sum() < 4_000_000:  # few sets share each n-gram: count the pairs themselves
            start = np.cumsum(size_b) - size_b
            many = size_b[fa]
            left = np.repeat(xa, many)
            right = xb[np.repeat(start[fa] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            out += np.bincount(left * len(b) + right, minlength=out.size).reshape(out.shape)
        else:
            dense = lambda f, x, rows: (m := np.zeros((rows, COLUMNS), np.float32), m.__setitem__((x, f), 1))[0]
            out += np.rint(dense(fa, xa, len(a)) @ dense(fb, xb, len(b)).T).astype(np.int64)
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite graph of rows and columns that ``near`` joins: (row, column)."""
    out, rows, columns = [], np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool)
    for first in np.flatnonzero(near.any(1)):
        if rows[first]:
            continue
        rows[first], todo = True, [(0, int(first))]
        while todo:
            side, x = todo.pop()
            fresh = np.flatnonzero((near[x] & ~columns) if side == 0 else (near[:, x] & ~rows))
            (columns if side == 0 else rows)[fresh] = True
            out += [(x, int(y)) if side == 0 else (int(y), x) for y in fresh]
            todo += [(1 - side, int(y)) for y in fresh]
    return out


def groups(batches: Iterator[pa.RecordBatch], key: list[str], values: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of rows that are sorted by key; the rows of a key must be used up before the next one is asked for."""
    rows = ((k, v) for b in batches for k, v in zip(zip(*(b.column(c).to_pylist() for c in key), strict=True), zip(*(b.column(c).to_pylist() for c in values), strict=True), strict=True))
    return ((k, (v for _, v in same)) for k, same in groupby(rows, itemgetter(0)))


def pivot_overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, common): what sets share with their pivots in each fragment, of rows (pivot, part, fragment, is_pivot, node, size, grams) with pivots first."""
    kind = rows.schema["node"].dataType
    arrow = to_arrow_type(kind)
    fields = [T.StructField("a", kind), T.StructField("b", kind), *(T.StructField(c, T.LongType()) for c in ("size_a", "size_b", "common"))]
    kinds = [arrow, arrow, pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        out = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [f.name for f in fields])
        for _, own in groups(batches, ["pivot", "part", "fragment"], ["is_pivot", "node", "size", "grams"]):
            heads, last = [], None
            for is_pivot, node, size, grams in own:
                if node["set_id"] == last:  # rows that share id and text
                    continue
                last, g = node["set_id"], np.frombuffer(grams, U)
                if is_pivot:
                    heads.append((node, size, g))
                    continue
                for b, size_b, h in heads:
                    if len(g) and len(h):
                        at = np.minimum(np.searchsorted(h, g), len(h) - 1)
                        out.append((node, b, size, size_b, int(np.count_nonzero(h[at] == g))))
            if len(out) >= 2000:
                yield pack()
                out = []
        yield pack()

    return rows.mapInArrow(run, T.StructType(fields))


def chunk_overlaps(rows: DataFrame) -> DataFrame:
    """(comp, i, j, fragment, a, b, common): what the sets of two chunks share in each fragment, as a packed matrix, of rows (comp, i, j, fragment, chunk, node, size, grams) in a fixed order.

    a and b are the nodes and sizes of its rows and columns, told with the first fragment only.
    """
    kind = rows.schema["node"].dataType
    member = T.StructType([T.StructField("node", kind), T.StructField("size", T.LongType())])
    side = T.ArrayType(member)
    fields = [*(rows.schema[c] for c in ("comp", "i", "j", "fragment")), T.StructField("a", side), T.StructField("b", side), T.StructField("common", T.BinaryType())]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for key, own in groups(batches, ["comp", "i", "j", "fragment"], ["chunk", "node", "size", "grams"]):
            _, i, j, fragment = key
            # Rows that share id and text are one set.
            once = {node["set_id"]: (c, {"node": node, "size": size}, np.frombuffer(g, U)) for c, node, size, g in own}
            held = list(once.values())
            a = [x for x in held if x[0] == i]
            b = a if i == j else [x for x in held if x[0] == j]
            if not a or not b:
                continue
            common = overlaps([x[2] for x in a], [x[2] for x in b]).astype(np.int32)
            names = ([x[1] for x in a], [x[1] for x in b]) if fragment == 0 else (None, None)
            row = (*key, *names, zlib.compress(common.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def summed(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each two chunks, of the rows of ``chunk_overlaps`` sorted by comp, i, j, fragment."""
    kind = rows.schema["a"].dataType.elementType["node"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        for (_, i, j), own in groups(batches, ["comp", "i", "j"], ["a", "b", "common"]):
            total = 0
            for x, y, packed in own:
                if x is not None:
                    a, b = x, y
                total = total + np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64)
            size = lambda s: np.array([m["size"] for m in s], np.int64)
            common = total.reshape(len(a), len(b))
            near = 100 * common >= percent * (size(a)[:, None] + size(b)[None, :] - common)
            if i == j:
                np.fill_diagonal(near, False)
            links = [(a[x]["node"], b[y]["node"]) for x, y in forest(near)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], arrow) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def pivot_units(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, units): where each id of the pairs ``edges`` meets pivots, as (pivot, part): pairs with one pivot are dealt over parts, by their number and size."""
    sizes = members.groupBy(F.col("id").alias("b")).agg(F.max("size").alias("size"))
    stars = edges.groupBy("b").agg(F.count("*").alias("n")).join(sizes, "b")
    parts = F.greatest(F.ceil(F.col("n") / CHUNK_SETS), F.ceil(F.col("n") * F.col("size") / CHUNK_GRAMS)).cast("int")
    stars = stars.select("b", parts.alias("parts"))
    own = edges.join(stars, "b").select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    heads = stars.select(F.col("b").alias("id"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return own.union(heads).groupBy("id").agg(F.collect_list(F.struct("pivot", "part")).alias("units"))


def pivot_links(grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): the linked nodes among pairs with pivots, by partial overlaps summed per pair."""
    rows = grams.select("id", "node", "size", "parts", F.explode("units").alias("u"))
    rows = rows.select("u.pivot", "u.part", (F.col("id") == F.col("u.pivot")).alias("is_pivot"), "node", "size", F.posexplode("parts").alias("fragment", "grams"))
    key = ["pivot", "part", "fragment"]
    partial = pivot_overlaps(rows.repartition(*key).sortWithinPartitions(*key, F.col("is_pivot").desc(), "node.set_id"))
    total = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return total.where(100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))).select("a", "b")


def chunk_links(members: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all linked nodes of each block of ``members`` (set_id, comp, size), chunk by chunk."""
    shapes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("size") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    dealt = members.join(shapes, "comp").select("set_id", "comp", "chunks", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int").alias("chunk"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(grams.select("set_id", "node", "size", "parts"), "set_id")
    meets = meets.select("comp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "size", F.posexplode("parts").alias("fragment", "grams"))
    key = ["comp", "i", "j", "fragment"]
    # One order of sets in all fragments, so that their matrices add up.
    partial = chunk_overlaps(meets.repartition(*key).sortWithinPartitions(*key, "node.set_id"))
    return summed(partial.repartition("comp", "i", "j").sortWithinPartitions(*key), percent)


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Texts link when 100 * intersection >= percent * union of their sets of n-word shingles (words are
    lower-cased in A-Z and parted by ASCII whitespace); component_id is the smallest doc_id reachable.
    """
    tune(spark)
    Classes(percent)
    scratch = scratch or Scratch(spark, "ngram-join")
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(described(docs, n, percent), "sets")
    edges, block = blocks(spark, rows, scratch)

    some = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("pick"), F.max("n_shingles").alias("size"), F.max(F.get("parts", F.lit(0))["owner"]).alias("owner"))
    some = some.withColumn("id", F.shiftleft(F.shiftright("owner", CLASS_BITS), CLASS_BITS)).join(block, "id").select("id", "set_id", "pick", "size", "comp")
    some = scratch.keep(some, "members")
    # The wanted sets grow with the input, so they are never broadcast.
    wanted = some.join(pivot_units(edges, some), "id")
    picked = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("pick"))).select("text", "id", "set_id", "pick", "size", "units")
    # The order of nodes makes the smallest id the name of a component.
    node = F.struct(F.col("pick").isNull().alias("none"), "pick", "set_id").alias("node")
    grams = scratch.keep(gathered(picked, n).select("id", "set_id", "size", node, "parts", "units"), "grams")
    links = scratch.keep(pivot_links(grams, percent), "links")
    near = components(spark, links, scratch)

    labels = some.select("id", "comp", "size", node, "set_id").join(near.select(F.col("id").alias("of"), F.col("comp").alias("label")), F.col("node.set_id") == F.col("of.set_id"), "left")
    labels = labels.withColumn("label", F.coalesce("label", "node"))
    shapes = labels.groupBy("comp").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    tried = edges.join(some.groupBy(F.col("id").alias("a")).agg(F.min("comp").alias("comp")), "a").groupBy("comp").agg(F.count("*").alias("tried"))
    untried = F.col("m") * (F.col("m") - 1) / 2 > F.coalesce("tried", F.lit(0))
    still = shapes.where("low <> high").join(tried, "comp", "left").where(untried).select("comp")
    open_ = scratch.keep(some.join(still, "comp", "left_semi").select("set_id", "comp", "size"), "open")
    # Only open blocks join more than the pairs with pivots have; what these have joined is told by each set's component.
    more = chunk_links(open_, grams, percent)
    if open_.limit(1).count():
        joined = near.select(F.col("id").alias("a"), F.col("comp").alias("b"))
        near = components(spark, joined.union(scratch.keep(more, "more")), scratch)
    comp = near.select("id.set_id", F.col("comp.pick").alias("least"), F.lit(True).alias("linked"))

    own = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("own"))
    names = own.join(comp, "set_id", "left").select("set_id", F.when(F.col("linked"), F.col("least")).otherwise(F.col("own")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(names, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"), n=4, percent=85)

"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised (lower-cased, runs of other than letters and digits become one space, none beside a letter
of ``UNSPACED`` scripts, each letter of which is a word). Equal lines, of any length, are one line from the
start; two hashes tell lines apart. Lines of at least ``MIN_WORDS`` words meet in two kinds of blocks:

- *Open segments.* A line is cut into ``SEGMENTS`` runs of words. Lines that agree in all but one run meet in the
  hash of the rest, given only where the open run holds at most 1 - ``SIMILARITY`` of the line's letters: then
  the edit distance of any two lines that meet cannot be above what is allowed, so all of them are linked,
  each with the least of the block, without a pair or a distance more.
- *SimHash.* A 64-bit SimHash of the line's distinct pairs of neighbouring words is summed within its row, in
  longs of counters as wide as their number needs. Pairs of words tell lines of the same words in other orders
  apart. Hashes that differ in at most three bits agree in two of five blocks, so lines meet in the buckets
  (length class, two blocks, their bits). A pair that is not joined yet and differs in at most ``BITS_APART``
  bits links if its edit similarity, 1 - distance / longer length, is at least ``SIMILARITY``.

Of each connected group only the first occurrence, by doc_id and line number, stays. Every link is one of edit
similarity. Lines whose edits lie in one run always meet (words of more than a fifth of the line apart); those
with edits in several runs, or with a word more or less, only if their SimHashes are near.

Within the SimHash buckets each line first meets one line of each; then every pair of a bucket that lies in two
components is compared, inside the join. All of it is DataFrame code. Texts of lines are neither written nor
shuffled; those of pairs to verify are read again.

Defined cases: a null text has no lines; lines without letters and digits always stay; lines of fewer words
only group with equal ones; rows that share an id are counted together, and occurrences that share id and
number are decided alike; null ids are one id and come first; lines of equal first and unequal second
hash take no part in fuzzy links; texts and lines are read whole, of any length; repeated rows repeat their
lines; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain, combinations
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from .common import Scratch, components, table, tune

MIN_WORDS, BITS_APART, SIMILARITY = 5, 3, 0.8
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Lines of equal first and unequal second hash that are sent to all tasks; more are joined by a shuffle.
TWINS = 100_000
#: Letters of the pieces whose edit distances bound that of a pair from above.
PIECE = 128
#: Runs of other than letters and digits, but for a single space, which stays as it is.
OTHER = "[^a-z\\p{L}\\p{Nd} ][^a-z\\p{L}\\p{Nd}]*| [^a-z\\p{L}\\p{Nd}]+"
#: All such runs, single spaces among them.
BETWEEN_WORDS = "[^\\p{L}\\p{Nd}]+"
#: The same in ASCII, where ranges are told faster.
BETWEEN_PLAIN_WORDS = "[^a-z0-9]+"


#: Runs of words of which one may stay open; half of what ``SIMILARITY`` allows, so that uneven words leave room.
SEGMENTS = 10
#: Letters of scripts that put no spaces between words.
UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"
BESIDE = f" (?:(?=[{UNSPACED}])|(?<=[{UNSPACED}] ))"
BETWEEN = f"(?<=[{UNSPACED}])(?! |$)|(?<! |^)(?=[{UNSPACED}])"


#: No letter of those scripts comes before Thai; a range is told faster than a script.
MAY_BE_UNSPACED = "[\\x{E00}-\\x{10FFFF}]"


def others(line: Column) -> Column:
    """Whether ``line`` may hold letters of ``UNSPACED`` scripts."""
    return (F.octet_length(line) > F.length(line)) & line.rlike(MAY_BE_UNSPACED)


def closed(line: Column) -> Column:
    """``line`` without spaces beside letters of ``UNSPACED`` scripts."""
    return F.when(others(line), F.regexp_replace(line, BESIDE, "")).otherwise(line)


def spaced(norm: Column) -> Column:
    """``norm`` with a space between any two words, those of ``UNSPACED`` scripts being single letters; ``closed`` undoes it."""
    return F.when(others(norm), F.regexp_replace(norm, BETWEEN, " ")).otherwise(norm)


def spaces(lower: Column) -> Column:
    """``lower``, a line in lower case, with one space in place of each run of other than letters and digits, none at the ends."""
    return F.trim(F.regexp_replace(lower, OTHER, " "))


def normalised(each: DataFrame) -> DataFrame:
    """``each`` (line, ...) with norm, the normalised line, in its place; a column a step, so that each is computed once."""
    return each.withColumn("norm", spaces(F.lower("line"))).withColumn("norm", closed(F.col("norm"))).drop("line")


def ids(norm: Column) -> tuple[Column, Column]:
    """The two hashes that tell normalised lines apart."""
    return F.xxhash64(norm), F.xxhash64(F.lit(1), norm)


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, line_id, check, size, view, words, n_words, letters) of every line; line_id is null for lines that always stay, view, the spaced line, and its words for those without fuzzy links; letters are those of the spaced line."""
    each = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # Lines are cut into words at once, which join to the normalised line; only those that may hold letters of other scripts are normalised first.
    each = each.withColumn("line", F.lower("line")).withColumn("_other", F.when(others(F.col("line")), closed(spaces(F.col("line")))))
    plain = F.octet_length("line") == F.length("line")
    own = F.array_remove(F.when(plain, F.split("line", BETWEEN_PLAIN_WORDS)).otherwise(F.split("line", BETWEEN_WORDS)), "")
    each = each.withColumn("words", F.when(F.col("_other").isNotNull(), F.split(spaced(F.col("_other")), " ")).otherwise(own)).drop("line")
    each = each.withColumn("view", F.array_join("words", " ")).withColumn("norm", F.coalesce("_other", "view")).withColumn("size", F.length("norm"))
    # Letters are counted once: other lines are their views.
    each = each.withColumn("letters", F.when(F.col("_other").isNull(), F.col("size")).otherwise(F.length("view")))
    some = F.col("size") > 0
    line_id, check = ids(F.col("norm"))
    each = each.withColumn("n_words", F.size("words"))
    fuzzy = [F.when(F.col("n_words") >= min_words, F.col(c)).alias(c) for c in ("view", "words")]
    return each.select("doc_id", "line_no", F.when(some, line_id).alias("line_id"), F.when(some, check).alias("check"), "size", *fuzzy, "n_words", "letters")


OPEN = [f"open_{i}" for i in range(SEGMENTS)]


def open_segments(told: DataFrame) -> DataFrame:
    """``told`` (view, words, size, n_words, letters, ...) with a key for each segment left open, null where it is empty or holds too many letters."""
    n = F.col("n_words")
    ends = [F.floor(n * i / SEGMENTS).cast("int") for i in range(SEGMENTS + 1)]
    own = [F.array_join(F.slice("words", ends[i] + 1, ends[i + 1] - ends[i]), " ") for i in range(SEGMENTS)]
    figures = {"_plain": F.col("letters") == F.col("size"), "_ascii": F.col("letters") == F.octet_length("view")}
    # Segments are told as bytes, which lie where they are told; letters would be counted from the start each time. A space follows each but empty ones.
    sizes = {f"_size{i}": F.octet_length(own[i]) + (ends[i] < ends[i + 1]).cast("int") for i in range(SEGMENTS)}
    lengths = {f"_letters{i}": F.length(own[i]) for i in range(SEGMENTS)}
    cut = told.withColumns(figures | sizes | lengths)
    bytes_ = F.col("view").cast("binary")
    limit = F.floor(F.col("size") * F.lit(round(100 * (1 - SIMILARITY))) / 100)
    keys = {}
    first = F.lit(0)
    for i, name in enumerate(OPEN):
        size, length = F.col(f"_size{i}"), F.col(f"_letters{i}")
        # Beside unspaced letters the spaces at both ends may be there or not.
        letters = F.when(F.col("_ascii") | F.col("_plain"), length).otherwise(F.length(closed(own[i])) + 2)
        # The same words before and behind; equal text on either side of other boundaries is no danger, as it bounds the distance as well.
        key = F.xxhash64("_plain", F.substr(bytes_, F.lit(1), first), F.substr(bytes_, first + size, F.octet_length("view")))
        keys[name] = F.when((size > 0) & (letters <= limit), key)
        first = first + size
    return cut.withColumns(keys).drop(*figures, *sizes, *lengths)


def over_half(sums: list[Column], n: Column, lane: int) -> Column:
    """The bits that ``sums``, counts of bits in lanes of ``lane`` bits, give more than half of ``n``, which is below 1 << (lane - 2)."""
    ones = sum(1 << lane * k for k in range(64 // lane))
    # A count beyond n / 2 carries into the second highest bit of its lane; no sum reaches the highest.
    fill = (F.lit((1 << (lane - 2)) - 1) - F.floor(n / 2)).cast("long") * F.lit(ones)
    out = F.lit(0).cast("long")
    for j, x in enumerate(sums):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x + fill, lane - 2).bitwiseAND(F.lit(ones)), j))
    return out


def majority(hashes: Column, n: Column, lane: int) -> Column:
    """The bits that more than half of the ``n`` hashes have, ``n`` below 1 << (lane - 2), counted in lanes of ``lane`` bits."""
    ones = sum(1 << lane * k for k in range(64 // lane))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(lane)])
    add = lambda acc, h: F.struct(*[(acc[f"s{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones))).alias(f"s{j}") for j in range(lane)])
    return F.aggregate(hashes, zero, add, lambda acc: over_half([acc[f"s{j}"] for j in range(lane)], n, lane))


#: Hashes that one row of the sums below takes in, the lanes of its sums, and how many hashes of a line still fit them.
CHUNK, LANE = 126, 16
FULL = 1 << (LANE - 2)
SUMS = [f"_s{j}" for j in range(LANE)]


def summed(taken: DataFrame, names: list[str]) -> DataFrame:
    """``taken`` with ``SUMS``, how many of the longs ``names`` (126 at most) have each bit, in lanes of ``LANE`` bits.

    Bits are added in lanes of 4, 8 and 16 bits, at each width as many longs as leave the highest bit of a lane free.
    """
    held, width, most = {0: names}, 1, 1
    for wide in (4, 8, LANE):
        group = ((1 << wide - 1) - 1) // most
        mask = F.lit(sum(((1 << width) - 1) << wide * k for k in range(64 // wide)))
        made, columns = {}, {}
        for r, own in held.items():
            for at in range(r, wide, width):
                parts = [F.shiftrightunsigned(c, at - r).bitwiseAND(mask) for c in own]
                made[at] = [f"_s{at}" if wide == LANE else f"_x{wide}_{at}_{g}" for g in range(-(-len(parts) // group))]
                columns |= {c: reduce(add, parts[g * group : (g + 1) * group]) for g, c in enumerate(made[at])}
        # A column a step, so that each is computed once; those of the width before go.
        taken = taken.withColumns(columns).drop(*chain(*held.values()))
        held, width, most = made, wide, most * group
    return taken


def chunk_rows(told: DataFrame) -> DataFrame:
    """``told`` (view or words, ...) with the SimHash of each line of at most ``CHUNK`` pairs; longer ones have a row for each chunk of theirs, with its ``SUMS``."""
    words = told if "words" in told.columns else told.withColumn("words", F.split("view", " "))
    words = words.withColumn("_next", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))))
    pairs = F.zip_with("words", "_next", lambda x, y: F.xxhash64(x, y))
    kept = [c for c in told.columns if c not in ("view", "words")]
    marks = words.withColumn("_marks", F.array_distinct(pairs)).select(*kept, "_marks").withColumn("_n", F.size("_marks"))
    m, n = F.col("_marks"), F.col("_n")
    several = (n > CHUNK) & (n < FULL)
    rows = marks.withColumn("_wide", F.when(n >= FULL, majority(m, n, 32))).withColumn("_row", F.monotonically_increasing_id())
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(m, c * CHUNK + 1, CHUNK))
    rows = rows.select(*kept, "_n", "_wide", "_row", F.posexplode(F.when(several, cut).otherwise(F.array(m))).alias("_chunk", "_c"))
    names = [f"_h{k}" for k in range(CHUNK)]
    taken = rows.withColumns({c: F.coalesce(F.get("_c", F.lit(k)), F.lit(0).cast("long")) for k, c in enumerate(names)}).drop("_c")
    whole = F.when((n > 0) & ~several, F.coalesce("_wide", over_half([F.col(c) for c in SUMS], n, LANE))).alias("simhash")
    return summed(taken, names).select(*kept, "_n", "_row", "_chunk", several.alias("_several"), whole, *[F.when(several, F.col(c)).alias(c) for c in SUMS])


def whole_rows(rows: DataFrame) -> DataFrame:
    """One row, with its SimHash, of each line of ``rows``, those of ``chunk_rows``."""
    kept = [c for c in rows.columns if not c.startswith("_") and c != "simhash"]
    each = rows.where("_several").groupBy("_row").agg(*[F.first(c).alias(c) for c in (*kept, "_n")], *[F.sum(c).alias(c) for c in SUMS])
    joint = each.withColumn("simhash", over_half([F.col(c) for c in SUMS], F.col("_n"), LANE))
    return rows.where("not coalesce(_several, false)").select(*kept, "simhash").union(joint.select(*kept, "simhash"))


def simhashes(told: DataFrame, lane: int | None = None) -> DataFrame:
    """``told`` with the SimHash of the distinct pairs of neighbouring words of ``view`` and its last word, null for a null one.

    Bits are counted in columns of a row; only lines of more than ``CHUNK`` pairs have several rows, told apart by a
    number of their own, whose counts are summed. Lines of more than ``FULL`` pairs, or all if a lane is given, are
    summed within an expression.
    """
    if lane is None:
        return whole_rows(chunk_rows(told))
    words = told.withColumn("_words", F.split("view", " "))
    pairs = F.zip_with("_words", F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    marks = words.withColumn("_marks", F.array_distinct(pairs)).drop("_words").withColumn("_n", F.size("_marks"))
    return marks.withColumn("simhash", F.when(F.col("view").isNotNull(), majority(F.col("_marks"), F.col("_n"), lane))).drop("_marks", "_n")


def stars(spark: SparkSession, firsts: DataFrame) -> DataFrame:
    """(a, b): each line with the line of the least id of each of its open segments; all of them are linked."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = firsts.select(F.explode(F.array(*OPEN)).alias("key"), F.col("line_id").alias("b")).where("key is not null and b is not null").repartition(spread, "key")
    # One exchange serves both sides of the join: neither asks for rows or columns that the other doesn't.
    least = rows.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("most")).where("a < most").select("key", "a")
    return rows.join(least.hint("shuffle_hash"), "key").where("a <> b").select("a", "b").distinct()


def members(hashes: DataFrame) -> DataFrame:
    """``hashes`` (line_id, simhash, size, ...) with a bucket for each pair of blocks, in the line's length class and the next if that may hold a partner."""
    own = F.floor(F.log2("size")).cast("long")
    partner = F.floor(F.log2(F.col("size") / F.lit(SIMILARITY))).cast("long")
    mask = lambda i: ((1 << BLOCKS[i][1]) - 1) << BLOCKS[i][0]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    # One long a bucket, so that nothing is built for each but its hash.
    key = [F.xxhash64(F.col("c") * 16 + t, F.col("simhash").bitwiseAND(signed(mask(i) | mask(j)))) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    each = hashes.withColumn("c", F.explode(F.array_distinct(F.array(own, partner))))
    return each.select(F.explode(F.array(*key)).alias("bucket"), *hashes.columns)


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def crowds(spark: SparkSession, hashes: DataFrame) -> DataFrame:
    """(bucket, line_id, simhash) of the buckets of three lines or more, and of those of two near ones."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange serves the figures of buckets and the rows that they are joined with, so the figures ask for the same columns.
    rows = members(hashes).select("bucket", "line_id", "simhash").where("bucket is not null").repartition(spread, "bucket")
    figures = rows.groupBy("bucket").agg(F.count("line_id").alias("n"), F.min("simhash").alias("least"), F.max("simhash").alias("most"))
    some = figures.where((F.col("n") > 2) | (F.col("n") == 2) & (apart("least", "most") <= BITS_APART)).select("bucket")
    return rows.join(some.hint("shuffle_hash"), "bucket")


def grouped(crowd: DataFrame, comp: DataFrame) -> DataFrame:
    """``crowd`` with the component of each line, itself where it has none."""
    return crowd.join(comp, "line_id", "left").withColumn("comp", F.coalesce("comp", "line_id"))


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each line with the line of the least id of each of its buckets, where they are near and lie in two components."""
    least = F.min(F.struct(F.col("line_id").alias("a"), F.col("simhash").alias("h"), F.col("comp").alias("comp_a")))
    pivots = rows.groupBy("bucket").agg(least.alias("p")).select("bucket", "p.*")
    near = (rows["bucket"] == pivots["bucket"]) & (F.col("comp_a") != F.col("comp")) & (apart("simhash", "h") <= BITS_APART)
    return rows.join(pivots, near).select("a", F.col("line_id").alias("b")).distinct()


def cross_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): all near pairs of a bucket that lie in two components."""
    side = lambda c: rows.select("bucket", F.col("line_id").alias(c), F.col("simhash").alias(f"h_{c}"), F.col("comp").alias(f"comp_{c}"))
    a, b = side("a"), side("b")
    close = (a["bucket"] == b["bucket"]) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & (apart("h_a", "h_b") <= BITS_APART)
    return a.join(b, close).select("a", "b").distinct()


def texts_of(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """(line_id, norm, n) of the lines at ``spots`` (line_id, check, doc_id, line_no); only texts that hold one are split."""
    wanted = spots.select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("line_id").alias("i"), "check")
    held = docs.join(wanted.select("d").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    each = held.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = normalised(each.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l"))).select("i", "check", "line"))
    # Rows that share an id have several lines of one number. A filter may become a key of the join and hash every line of the texts.
    line_id, check = ids(F.col("norm"))
    own = F.when((line_id == F.col("i")) & (check == F.col("check")), F.col("norm"))
    return each.groupBy(F.col("i").alias("line_id")).agg(F.first(own, ignorenulls=True).alias("norm")).withColumn("n", F.length("norm"))


def similar(both: DataFrame) -> DataFrame:
    """(a, b, linked) of the pairs ``both`` (a, b, t_a, t_b, n_a, n_b: different lines and their lengths), linked at edit similarity ``SIMILARITY`` or more.

    Common words at both ends go first, which changes no distance. The distances of pieces, added up, are an
    upper bound of what is left; the whole distance is computed only where that bound is too high. A filter by
    ``linked`` belongs behind a written table: pushed down, it would evaluate the columns it needs anew at each use.
    """
    first_apart = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    cut = both.withColumn("w_a", F.split("t_a", " ")).withColumn("w_b", F.split("t_b", " ")).withColumn("head", first_apart(F.col("w_a"), F.col("w_b")))
    for c in ("a", "b"):
        cut = cut.withColumn(f"r_{c}", F.reverse(F.slice(f"w_{c}", F.col("head"), F.size(f"w_{c}"))))
    cut = cut.withColumn("tail", first_apart(F.col("r_a"), F.col("r_b")))
    for c in ("a", "b"):
        cut = cut.withColumn(f"m_{c}", F.array_join(F.reverse(F.slice(f"r_{c}", F.col("tail"), F.size(f"r_{c}"))), " "))
    cut = cut.withColumn("len_a", F.length("m_a")).withColumn("len_b", F.length("m_b"))
    longest = F.greatest("len_a", "len_b")
    # Where one line holds nothing between the ends, the other has one space more.
    limit = F.floor(F.greatest("n_a", "n_b") * F.lit(round(100 * (1 - SIMILARITY))) / 100) - F.when(F.least("len_a", "len_b") == 0, 1).otherwise(0)
    cut = cut.withColumn("limit", limit.cast("int"))
    piece = lambda c, i: F.substr(F.col(c), i * PIECE + 1, F.lit(PIECE))
    bound = F.aggregate(F.sequence(F.lit(0), F.floor(longest / PIECE).cast("int")), F.lit(0), lambda acc, i: acc + F.levenshtein(piece("m_a", i), piece("m_b", i)))
    linked = F.when(longest <= F.col("limit"), True).when(bound <= F.col("limit"), True)
    linked = linked.when(F.expr("levenshtein(m_a, m_b, cast(floor(limit / 8) as int)) >= 0"), True).otherwise(F.expr("levenshtein(m_a, m_b, limit) >= 0"))
    alike = F.least("n_a", "n_b") >= F.lit(SIMILARITY) * F.greatest("n_a", "n_b")
    return cut.select("a", "b", F.when(alike, linked).otherwise(False).alias("linked"))


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within, a stage whose one method would be too long for the JVM to compile is made of several."""
    name, limit = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(limit, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def place_of(docs: DataFrame) -> tuple[Column, Callable[[Column], Column]]:
    """What orders lines (doc_id, line_no) by id, null first, and number, and how it is told as (doc_id, line_no): a long where ids leave room, which takes no sort to group by."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, LongType | IntegerType):
        least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if least is None or least >= 0 and most < (1 << 32) - 1:
            place = F.shiftleft(F.coalesce(F.col("doc_id").cast("long") + 1, F.lit(0)), 31).bitwiseOR(F.col("line_no").cast("long"))
            doc = lambda p: F.nullif(F.shiftright(p, 31), F.lit(0)) - 1
            return place, lambda p: F.struct(doc(p).cast(kind).alias("doc_id"), p.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no"))
    return F.struct("doc_id", "line_no"), lambda p: p


def decide(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, line_no, group_id, kept) of every line of ``docs`` (doc_id, text); group_id is null for lines that always stay."""
    tune(spark)
    scratch = scratch or Scratch(spark, "line-dedup")
    docs = docs.select("doc_id", "text")
    # Texts of lines are neither written nor shuffled, but for those of the pairs to verify.
    told = chunk_rows(open_segments(lines(docs)))
    with compiled(spark):
        rows = scratch.keep(told.drop("n_words", "letters"), "lines", dictionary=False)
    wide = whole_rows(rows).withColumn("size", F.when(F.col("simhash").isNotNull(), F.col("size")))
    figures = [F.first(c).alias(c) for c in ("simhash", "size", *OPEN)]
    place, told_as = place_of(docs)
    met = wide.where("line_id is not null").groupBy("line_id", "check").agg(F.min(place).alias("at"), *figures).withColumn("at", told_as(F.col("at")))
    segments = scratch.keep(met, "segments", dictionary=False)
    # The keys of open segments are most of both tables; they go as soon as they have met.
    every = scratch.keep(rows.where("_chunk = 0").select("doc_id", "line_no", "line_id", "check"), "every", dictionary=False)
    scratch.drop(rows)
    known = every.where("line_id is not null")
    firsts = scratch.keep(segments.select("line_id", "check", "at", "simhash", "size"), "firsts", dictionary=False)
    # Lines told apart by the second hash only have no fuzzy links.
    twins = scratch.keep(firsts.groupBy("line_id").count().where("count > 1").select("line_id"), "twins")
    few = F.broadcast(twins) if twins.count() <= TWINS else twins
    hashes = firsts.join(few, "line_id", "left_anti").where("simhash is not null").select("line_id", "simhash", "size")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs, "pairs")
        members = pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct()
        spots = scratch.keep(firsts.join(members, "line_id", "left_semi").select("line_id", "check", "at.doc_id", "at.line_no"), "spots")
        texts = scratch.keep(texts_of(docs, spots), "texts")
        side = lambda c: texts.select(F.col("line_id").alias(c), F.col("norm").alias(f"t_{c}"), F.col("n").alias(f"n_{c}"))
        # Pairs are few bytes and much work, so they are spread before their texts join them.
        spread = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        return scratch.keep(similar(spread.join(side("a"), "a").join(side("b"), "b")), name).where("linked").select("a", "b")

    def joined(links: DataFrame) -> DataFrame:
        return components(spark, links, scratch).withColumnRenamed("id", "line_id")

    comp = joined(stars(spark, segments.join(few, "line_id", "left_anti")))
    scratch.drop(segments)
    crowd = scratch.keep(crowds(spark, hashes), "crowds")
    for pairs, name in ((pivot_pairs, "links"), (cross_pairs, "more")):
        links = verified(pairs(grouped(crowd, comp)), name)
        if links.limit(1).count():
            comp = joined(links.union(comp.select("line_id", "comp")))
    scratch.drop(crowd)

    group = F.when(F.col("simhash").isNotNull(), F.coalesce("comp", "line_id")).otherwise(F.col("line_id"))
    placed = scratch.keep(firsts.join(comp, "line_id", "left").select("line_id", "check", group.alias("group_id"), "at"), "grouped")
    # Lines that share a group only by their first hash keep their own firsts.
    joint = placed.join(comp.select("line_id").distinct(), "line_id", "left_semi").groupBy("group_id").agg(F.min("at").alias("head"))
    groups = placed.join(joint, "group_id", "left").select("line_id", "check", "group_id", F.coalesce("head", "at").alias("head"))
    out = known.select("doc_id", "line_no", "line_id", "check").join(groups, ["line_id", "check"])
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    free = every.where("line_id is null").select("doc_id", "line_no", F.lit(None).cast("long").alias("group_id"), F.lit(True).alias("kept"))
    return out.select("doc_id", "line_no", "group_id", same.alias("kept")).union(free)


def cleaned(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with the lines that do not stay cut from ``text``; all its columns pass."""
    gone = decisions.where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = docs.select(row).join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return both.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decided = decide(spark, docs)
    gone = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))), lambda x: x.cast("string")), ",")
    told = decided.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), gone.alias("removed_lines"))
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(told, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(F.col("id").alias("doc_id"), zero("n_lines"), zero("n_kept"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))

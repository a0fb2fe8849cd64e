"""Alignment of two tokenizers against plain code over whole texts, and the monoid's laws."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pricelake.llm import alignment as al
from pricelake.llm import tokens as T

ODD = ["a", "the", "é", "中文", "，", " ", "  ", "\n", "\t", "'s", "12", ",", "<|endoftext|>", "\x00", "\x1c", "ﬁ", "🙂", "straight", "café-owner", " "]


def mixed(rng, n):
    return "".join(rng.choice(ODD) for _ in range(n))


def test_words_are_tokenised_as_in_their_text():
    rng = random.Random(1)
    for _ in range(300):
        s = mixed(rng, rng.randrange(1, 30))
        w = T.words(s)
        assert T.ids_of([s])[0] == sum(T.ids_of([w[0], *[" " + x for x in w[1:]]]), [])
        assert T.piece_bpe().encode(s) == sum(T.pieces_of([" " + x for x in w]), [])
        spaced = [" " + x for x in w]
        arrow = pa.array(spaced, pa.large_string())
        for one, (ids, n) in ((T.ids_of, T.byte_words(arrow)), (T.pieces_of, T.piece_words(arrow))):
            assert ids.tolist() == sum(one(spaced), []) and n.tolist() == [len(x) for x in one(spaced)]
    with pytest.raises(ValueError):
        T.check_pieces(["a▁b"])


def test_both_libraries_part_texts_alike():
    """Each character of the first 200,000 between letters, numbers, marks and spaces."""
    each = [f"a{c}a 1{c}1 {c}.{c}. {c}{c} x{c} {c}" for c in map(chr, [*range(0xD800), *range(0xE000, 200_000)])]
    for i in range(0, len(each), 10_000):
        assert T.ids_of(each[i : i + 10_000]) == T.ranked().encode_ordinary_batch(each[i : i + 10_000])


def test_distinct_words_of_texts():
    rng = random.Random(9)
    texts = [None, "", " ", "a  b", *[mixed(rng, rng.randrange(20)) for _ in range(200)]]
    for first in (False, True):
        d = T.Distinct(pa.array(texts), first)
        for i, s in enumerate(texts):
            own = d.at[d.begin[i] : d.begin[i] + d.n[i]].tolist()
            assert [d.words[w].as_py() for w in own] == (T.words(s) if s else [])
            assert [w >= d.heads for w in own] == [first] * bool(own) + [False] * (len(own) - 1)
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 30]}) for i in range(0, len(texts), 30)]
    for size in (1, 50, 10_000):
        assert [x for b in T.slices(iter(batches), size) for x in b.column("text").to_pylist()] == texts


def same(x, y):
    flat = lambda f: [f.cut, f.groups, f.n, *[p.tolist() for s in (*f.head, *f.tail) for p in (s.ids, s.ends)], f.codes.tolist(), f.times.tolist()]
    return flat(x) == flat(y)


def test_fragments_compose_in_any_tree():
    rng, pair, pairs = random.Random(2), al.Pair(), T.piece_pairs()
    for _ in range(60):
        text = " " + mixed(rng, 120)
        parts = al.ranges(text, rng.choice([3, 11, 40]), pairs)
        assert "".join(p[0] for p in parts) == "".join(p[2] for p in parts) == text
        each = [al.fragment(*pair.sides(*p)) for p in parts]
        whole = al.joined(al.START, al.fragment(*pair.sides(text, 0, text, 0)))
        left = al.START
        for f in each:
            left = al.joined(left, f)
        todo = [al.START, *each]
        while len(todo) > 1:
            i = rng.randrange(len(todo) - 1)
            todo[i : i + 2] = [al.joined(todo[i], todo[i + 1])]
        assert same(left, whole) and same(todo[0], whole)
        assert same(al.joined(al.EMPTY, whole), whole) and same(al.joined(whole, al.EMPTY), whole)
        assert not len(whole.tail[0].ids) and whole.n[3] == whole.n[0] + whole.n[1] - whole.n[2]


def test_groups_open_on_both_edges_are_kept():
    side = lambda ids, ends: al.Side(np.array(ids), np.array(ends))
    a, b = side([1, 2, 3, 4], [4, 6, 9, 12]), side([5, 6, 7, 8], [2, 6, 10, 12])
    whole = al.fragment(a, b, closed=True)
    assert whole.groups == "1,2|5,6;3,4|7,8" and whole.n == (4, 4, 2, 6)
    # Either side cut at a place of its own: the common end at 6 is known to no range alone.
    x, y = al.fragment(side([1, 2], [4, 6]), side([5], [2])), al.fragment(side([3, 4], [9, 12]), side([6, 7, 8], [6, 10, 12]))
    assert not x.cut and y.cut and same(al.joined(al.joined(al.START, x), y), whole)


def test_whole_operator_against_plain_code(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "plain words here", "plain words here", "mark ▁ inside", mixed(rng, 30), "x" * 300, "中" * 200 + "，" + "文" * 90, *[mixed(rng, rng.choice([5, 60, 400, 900])) for _ in range(12)]]
    rows = [(None if i == 3 else i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    want = sorted(zip([r[0] for r in rows], al.brute_force(texts)), key=str)
    for options in ({}, {"size": 64}, {"size": 64, "block": 150}):
        got, pairs = al.align(spark, docs, **options)
        assert sorted(((r[0], tuple(r[1:])) for r in got.collect()), key=str) == want
    assert pairs.where("best").count() >= pairs.select("b").distinct().count() > 0
    assert al.align(spark, docs.where("false"))[0].count() == 0


def test_query(spark):
    got = {r[0]: tuple(r[1:]) for r in al.op12(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], al.brute_force([r.text for r in rows])))

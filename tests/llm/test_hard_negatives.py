"""Hard negatives against plain code, on rows with nulls, ties, repeated and clustered vectors."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pricelake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute_force(rows, is_anchor, n_positives=5, n_negatives=10):
    live = []
    for i, vector, label, *_ in rows:
        if None in (i, vector, label) or any(x is None or not np.isfinite(np.float32(x)) for x in vector):
            continue
        live.append((i, label, [int(np.floor(float(np.float32(x)) * 256)) for x in vector]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, label, q in live:
        if not is_anchor(i):
            continue
        own = sorted(((-dot(q, r), j) for j, m, r in live if m == label and j != i))[:n_positives]
        other = sorted((-dot(q, r), j) for j, m, r in live if m != label)
        for ps, p in own:
            fits = [(s, j) for s, j in other if 30 * -ps <= 100 * -s <= 90 * -ps][:n_negatives]
            for rank, (s, j) in enumerate(fits, 1):
                out[i, p, rank, j, -ps, -s] += 1
    return out


def vectors(rng, n=400, dim=12):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(4), "clash"))
    rows += [(n + i, rows[7][1], i % 4, "clash") for i in range(60)]  # one vector many times
    rows += [rows[20], rows[20], rows[21], rows[21]]  # repeated rows, one of them an anchor
    rows += [(None, rows[0][1], 1, ""), (900, None, 1, ""), (901, rows[0][1], None, ""), (920, [None] * dim, 1, ""), (940, [float("nan")] * dim, 1, ""), (960, [float("inf")] * dim, 1, "")]
    rows += [(980, [0.0] * dim, 2, ""), (981, [], 2, ""), (1000, rows[3][1][:5], 2, ""), (1001, [-x for x in rows[0][1]], 3, ""), (1020, [x * 300 for x in rows[5][1]], 1, "")]
    return rows


def test_against_plain_code(spark):
    rng = random.Random(6)
    rows = vectors(rng)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_force(rows, lambda i: i % 20 == 0)
    for options in ({}, {"block": 7, "pilot": 3}):
        got = hn.hard_negatives(spark, df, F.col("vec_id") % 20 == 0, **options).collect()
        assert Counter(map(tuple, got)) == want and len(got) > 500
    assert hn.hard_negatives(spark, df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert hn.hard_negatives(spark, df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -3e5, 0.5 * i], i % 2, "") for i in range(30)]
    got = hn.hard_negatives(spark, spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert Counter(map(tuple, got)) == brute_force(rows, lambda i: i % 10 == 0)


def test_no_score_is_above_its_bound():
    rng = np.random.default_rng(7)
    q = rng.integers(-300, 300, (200, 8))
    rows = rng.integers(-900, 900, (500, 8))
    found = hn.clustered(q)
    for c in range(len(found.centres)):
        own = q[found.of == c]
        if len(own):
            assert (hn.products(own, rows) <= hn.unit(own)[1][:, None] * hn.bounds(rows, found.centres[c], found.angle[c])[None, :]).all()


def test_members_stop_early():
    """Around tight clusters most rows are never scored."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    make = lambda n: np.floor(256 * (centres[rng.integers(0, 40, n)] + 0.02 * rng.normal(size=(n, 16)))).astype(np.int64)
    q, rows = make(400), make(8000)
    wide = np.iinfo(np.int64)
    b = hn.Block(np.arange(400), np.zeros(400, np.int64), q, np.arange(400), np.arange(400), True, np.full(400, wide.min), np.full(400, wide.max), 5)
    walk = b.walk()
    walk.part(np.arange(1000, 9000), np.zeros(8000, np.int64), rows)
    assert walk.scored < 0.25 * 400 * 8000
    exact = hn.products(q, rows)
    for i in range(400):
        assert walk.score[walk.slot == i].tolist() == sorted(exact[i].tolist(), reverse=True)[:5]

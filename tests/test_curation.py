"""Batches of decisions, repeated ones too, and trees of any depth."""

import random
from datetime import datetime

from pricelake.operators import catalog, categories, curation
from pricelake.operators.matching import ITEM
from pricelake.sources.tables import scratch_keep

NODES = "category_id string, kind string, name string, slug string, path string, parent_id string, is_archived boolean"
LISTINGS = "product_id string, item_id string"
CANDIDATES = "candidate_id string, product_id string, item_id string, status string"


def tree(spark, archived=()):
    chain = [("a", None), ("a/b", "a"), ("a/b/c", "a/b"), ("a/b/c/d", "a/b/c"), ("a/b/c/d/e", "a/b/c/d"), ("z", None)]
    return spark.createDataFrame([(i, "Shelf", i, i[-1], i, p, i in archived) for i, p in chain], NODES)


def items(spark, ids):
    return spark.createDataFrame([tuple(i if c == "item_id" else None for c in ITEM) for i in ids], ", ".join(f"{c} string" for c in ITEM))


def test_subtrees_reach_any_depth(spark):
    of = lambda df, root: sorted(r.category_id for r in categories.category_subtree(df, root).collect())
    assert of(tree(spark), "a") == ["a", "a/b", "a/b/c", "a/b/c/d", "a/b/c/d/e"]
    assert of(tree(spark, ["a/b/c"]), "a") == ["a", "a/b"] and of(tree(spark, ["a"]), "a") == [] and of(tree(spark), "?") == []
    counts = spark.createDataFrame([("a/b/c/d/e", 3), ("a/b", 2)], "category_id string, n long")
    shown = lambda df, kind=None: {r.category_id: (r.depth, r.total) for r in categories.category_tree(df, counts, kind).collect()}
    # All nodes are of one kind here; the cut is by depth, and sums count what it hides.
    assert shown(tree(spark)) == {"a": (0, 5), "a/b": (1, 5), "a/b/c": (2, 3), "z": (0, 0)}
    assert shown(tree(spark), "aisle") == {"a": (0, 5), "a/b": (1, 5), "z": (0, 0)} and shown(tree(spark), "Department") == {"a": (0, 5), "z": (0, 0)}
    assert shown(tree(spark, ["a/b"]), "Department") == {"a": (0, 0), "a/b/c": (0, 3), "z": (0, 0)}
    round_ = spark.createDataFrame([("p", "Shelf", "p", "p", "p", "q", False), ("q", "Shelf", "q", "q", "q", "p", False)], NODES)
    assert shown(round_) == {}


def test_category_edits(spark):
    edits = [("1", "archive", "a", None, None, None), ("2", "archive", "a/b/c", None, None, None), ("3", "create", None, "z", "aisle", " New One "), ("4", "create", None, "z", "Wing", "x"), ("5", "archive", "?", None, None, None)]
    edits = spark.createDataFrame(edits, "edit_id string, op string, category_id string, parent_id string, kind string, name string")
    after, outcomes = curation.apply_category_edits(tree(spark, ["a/b/c"]), edits)
    assert {r.edit_id: (r.outcome, r.flipped) for r in outcomes.collect()} == {"1": ("archived", 4), "2": ("archived", 2), "3": ("created", 0), "4": ("rejected", 0), "5": ("rejected", 0)}
    got = {r.category_id: (r.is_archived, r.kind) for r in after.collect()}
    assert got == {**{i: (True, "Shelf") for i in ("a", "a/b", "a/b/c", "a/b/c/d", "a/b/c/d/e")}, "z": (False, "Shelf"), "z/new-one": (False, "Aisle")}


def test_nested_edits_of_one_batch(spark):
    rows = [("4", "z/a/b", " C "), ("1", "z", "A"), ("2", "z/a", "B"), ("3", "z/a", "b"), ("5", "z/?", "X"), ("6", None, "New")]
    edits = spark.createDataFrame([(i, "create", None, p, "shelf", n) for i, p, n in rows], "edit_id string, op string, category_id string, parent_id string, kind string, name string")
    after, outcomes = curation.apply_category_edits(tree(spark), edits)
    assert {r.edit_id: r.outcome for r in outcomes.collect()} == {"1": "created", "2": "created", "3": "rejected", "4": "created", "5": "rejected", "6": "created"}
    assert {"z/a", "z/a/b", "z/a/b/c", "new"} <= {r.path for r in after.where("not is_archived").collect()}


def test_reviews_tell_when(spark):
    candidates = spark.createDataFrame([("c1", "p1", "i1", "Pending", None), ("c2", "p2", "i2", "Pending", None)], CANDIDATES + ", reviewed_at timestamp")
    now = datetime(2026, 2, 3)
    left, _, _ = curation.apply_review_decisions(candidates, spark.createDataFrame([("p1", None)], LISTINGS), items(spark, ["i1", "i2"]), spark.createDataFrame([("c1", True)], "candidate_id string, approve boolean"), now)
    assert {r.candidate_id: r.reviewed_at for r in left.collect()} == {"c1": now, "c2": None}


def sequential(ids, requests):
    """One merge after another."""
    into, out = {}, []
    for s, t in requests:
        if s not in ids or t not in ids:
            out.append("unknown")
        elif s == t:
            out.append("self")
        else:
            while t in into:
                t = into[t]
            if s in into:
                out.append("again")
            elif t == s:
                out.append("cycle")
            else:
                into[s] = t
                out.append("merged")
    return into, out


def test_merges_follow_one_another(spark):
    ids = [f"i{n}" for n in range(12)]
    cases = [[("i0", "i1"), ("i1", "i2")], [("i1", "i2"), ("i0", "i1")], [("i0", "i1"), ("i1", "i0"), ("i1", "i3"), ("i3", "i0")], [("i2", "i2"), ("i2", "gone"), ("gone", "i2")]]
    rng = random.Random(5)
    cases += [[(rng.choice(ids), rng.choice(ids)) for _ in range(15)] for _ in range(3)]
    for requests in cases:
        pairs = spark.createDataFrame([(n, *r) for n, r in enumerate(requests)], "request_no long, source_id string, target_id string")
        listings = spark.createDataFrame([(f"p{i}", i) for i in ids], LISTINGS)
        after, moved, _, outcomes = curation.apply_item_merges(items(spark, ids), listings, spark.createDataFrame([], CANDIDATES), pairs)
        into, want = sequential(ids, requests)
        end = lambda i: end(into[i]) if i in into else i
        assert {r.item_id: end(r.item_id) for r in after.collect()} == {r.item_id: end(r.merged_into_id or r.item_id) for r in after.collect()}
        assert {r.item_id for r in after.where("merged_into_id is not null").collect()} == set(into)
        assert {r.product_id: r.item_id for r in moved.collect()} == {f"p{i}": end(i) for i in ids}
        got = sorted((r.source_id, r.target_id, "again" if r.outcome in ("conflict", "unchanged") else r.outcome) for r in outcomes.collect())
        assert got == sorted((*r, w) for r, w in zip(requests, want))


def test_repeated_review_decisions_have_one_effect(spark):
    candidates = spark.createDataFrame([("c1", "p1", "i1", "Pending"), ("c2", "p1", "i2", "Pending")], CANDIDATES)
    listings = spark.createDataFrame([("p1", None)], LISTINGS)
    decisions = spark.createDataFrame([("c1", False), ("c1", True), ("c1", True)], "candidate_id string, approve boolean")
    left, after, outcomes = curation.apply_review_decisions(candidates, listings, items(spark, ["i1", "i2"]), decisions)
    assert [(r.candidate_id, r.status) for r in left.collect()] == [("c1", "Approved")]
    assert [tuple(r) for r in after.collect()] == [("p1", "i1")] and sorted(r.outcome for r in outcomes.collect()) == ["approved", "conflict", "conflict"]


def test_repeated_links_have_one_winner(spark):
    listings = spark.createDataFrame([("p1", None), ("p2", "i1")], LISTINGS)
    links = spark.createDataFrame([("p1", "i2"), ("p1", "i1"), ("p1", "gone"), ("p2", None), ("p2", None)], LISTINGS)
    after, _, outcomes = curation.apply_manual_links(listings, spark.createDataFrame([], CANDIDATES), items(spark, ["i1", "i2"]), links)
    assert sorted(map(tuple, after.collect())) == [("p1", "i1"), ("p2", None)]
    assert sorted(map(tuple, outcomes.collect())) == [("p1", "conflict"), ("p1", "linked"), ("p1", "rejected"), ("p2", "cleared"), ("p2", "conflict")]


def test_repeated_items_are_made_once(spark):
    request = lambda i, n: (i, n, None, None, None, None)
    schema = "request_id string, name string, description string, brand string, size string, category string"
    rows = spark.createDataFrame([request("r1", "Jam"), request("r1", "Jam"), request("r2", " ")], schema)
    made, outcomes = curation.create_manual_items(items(spark, []).limit(0), rows)
    assert made.count() == 1 and sorted(r.outcome for r in outcomes.collect()) == ["created", "rejected", "unchanged"]
    again, outcomes = curation.create_manual_items(made, rows.limit(1))
    assert again.count() == 1 and outcomes.first().outcome == "unchanged"


def test_merges_keep_listings_without_item(spark):
    listings = spark.createDataFrame([("p1", None), ("p2", "i1"), ("p3", "i2")], LISTINGS)
    pairs = spark.createDataFrame([("i1", "i2")], "source_id string, target_id string")
    _, after, _, _ = curation.apply_item_merges(items(spark, ["i1", "i2"]), listings, spark.createDataFrame([], CANDIDATES), pairs)
    assert sorted(map(tuple, after.collect())) == [("p1", None), ("p2", "i2"), ("p3", "i2")]


def test_places_number_the_whole_table(spark, tmp_path):
    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = {r.id: r.place for r in catalog.placed(df, [df["k"].desc(), df["id"]], keep).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}


def test_cycles_of_any_graph_in_rounds_of_their_own_length(spark):
    rng, n = random.Random(7), 400
    to = {i: rng.randrange(1, n + 40) for i in range(1, n)}
    to |= {1000 + i: 1000 + (i + 1) % 37 for i in range(37)} | {2000 + i: 2000 + (i ^ 1) for i in range(600)}
    order = {s: rng.randrange(10**6) for s in to}
    want = set()
    for s in to:
        x, way = s, []
        while x in to and x not in way:
            way.append(x)
            x = to[x]
        if x in to:
            want.add(max(way[way.index(x) :], key=lambda y: (order[y], y)))
    edges = spark.createDataFrame([(str(s), str(t), (order[s], s)) for s, t in to.items()], "source_id string, to_id string, nr struct<no: long, id: long>")
    made = []

    def keep(df, name):
        made.append(name)
        return scratch_keep(spark)(df, name)

    assert {int(r.source_id) for r in curation._cycles(edges, keep).collect()} == want and len(want) > 300
    made.clear()
    short = edges.where("nr.id >= 2000")
    assert curation._cycles(short, keep).count() == 300 and len(made) == 3

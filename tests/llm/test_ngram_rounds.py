"""The near-copy stage asks the driver for no more jobs than its links need."""

from pyspark.sql import functions as F

from pricelake.llm import ngram_join
from pricelake.llm.common import Scratch, components

DOCS = "doc_id long, text string"


def texts(groups: int, copies: int) -> list[tuple[int, str]]:
    """Groups of copies of 60 words with one of them changed each."""
    words = lambda g, i: [f"g{g}w{k}" if k != i else f"x{g}y{i}" for k in range(60)]
    return [(10 * g + i, " ".join(words(g, i))) for g in range(groups) for i in range(copies)]


def test_settled_blocks_are_not_joined_again(spark, monkeypatch):
    """Where pairs with pivots leave no block open, the components of their links are the result."""
    calls, plain = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda *a: calls.append(plain(*a)) or calls[-1])
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(texts(6, 3), DOCS), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {10 * g + i: 10 * g for g in range(6) for i in range(3)}
    assert len(calls) == 2


def test_open_blocks_go_on_from_what_is_joined(spark, monkeypatch):
    """Chunks see a block that the pairs with pivots leave open; what these have joined goes in as one pair a set."""
    rows = texts(4, 5)
    seen, plain, links = [], ngram_join.components, ngram_join.pivot_links
    monkeypatch.setattr(ngram_join, "components", lambda spark, edges, scratch: seen.append(edges.count()) or plain(spark, edges, scratch))
    monkeypatch.setattr(ngram_join, "pivot_links", lambda *a: links(*a).where(F.col("a.pick") % 10 < 3))
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, DOCS), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 10 * 10 for d, _ in rows}
    assert len(seen) == 3


def test_a_round_asks_once_whether_it_is_the_last(spark):
    """Jobs of a chain's components: rounds of one written table and one question each."""
    scratch = Scratch(spark, "t")
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    asked, plain = [], type(edges).count
    type(edges).count = lambda self: asked.append(1) or plain(self)
    try:
        out = components(spark, edges, scratch)
    finally:
        type(edges).count = plain
    assert {r.id: r.comp for r in out.collect()} == dict.fromkeys(range(65), 0)
    assert len(asked) == scratch.n - 1

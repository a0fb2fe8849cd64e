"""Registered queries run, agree in columns with their SQL, and do not need the text subpackage."""

import duckdb
import pytest

from pricelake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["cheapest_by_product", "g4_availability", "m7_queue_candidates", "h4_price_as_of", "h4_price_as_of_in_ranges", "g1_reconstruct_was_price_in_ranges", "r1_search_listings", "r6_last_page", "t3_product_status_report", "c7_category_tree"]


@pytest.mark.parametrize("name", SOME)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())


def test_entry_lists_queries(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1

"""Seconds of the derived tables are rounded as their SQL rounds them."""

import duckdb
import pytest

from pricelake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
GIVEN = "region nation customer supplier part orders lineitem documents pages".split()
NAMES = ["g1_reconstruct_was_price", "g1_reconstruct_was_price_in_ranges", "g2_price_snapshots", "g3_current_listings", "g4_availability", "g5_apply_crawl_run", "g7_merge_category_links", "g7_product_category_links"]
NAMES += ["g9_close_crawl_runs", "s3_retained_runs", "t5_store_stats", "t6_crawl_run_report", "t7_staleness"]


@pytest.fixture(scope="module")
def near_midnight(tmp_path_factory):
    """The small tables with events moved to the last or first second of their day: at the half, just before it and just after it."""
    root = tmp_path_factory.mktemp("near")
    con = duckdb.connect()
    for t in GIVEN:
        (root / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    moved = "date_trunc('day', ts) + to_microseconds(CASE event_id % 5 WHEN 0 THEN 86399500000 WHEN 1 THEN 86399499999 WHEN 2 THEN 86399700000 WHEN 3 THEN 500000 ELSE 41000700000 END)"
    con.execute(f"COPY (SELECT * REPLACE ({moved} AS ts) FROM '{SF}/events.parquet') TO '{root}/events.parquet' (FORMAT parquet)")
    for t in (*GIVEN, "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return str(root), con


@pytest.mark.parametrize("name", NAMES)
def test_events_near_midnight_agree_with_sql(spark, near_midnight, name):
    root, con = near_midnight
    df = QUERIES[name](spark, root)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())

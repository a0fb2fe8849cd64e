"""The price state machine: cases, and the window form against a sequential fold and against one run at a time."""

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from pricelake.operators import history as prices
from pricelake.operators import ingest
from pricelake.sources.tables import scratch_keep
from pricelake.sources.versions import Version, Versions, part_name, read_parts, replace_parts
from pricelake.streaming.ingest import apply_batch, apply_due, closed_runs, read, read_state, stream_ingest

OBS = "store_id string, sku string, run_id string, seq long, price decimal(10,2), promo_type string, was_price decimal(10,2), unit_price decimal(12,4), member_price decimal(10,2), multibuy_quantity int, multibuy_total decimal(10,2)"
RUNS = "run_id string, store_id string, started_at timestamp, complete boolean, status string"
T0 = datetime(2026, 1, 1, tzinfo=UTC)


def history(seed, stores=2, skus=6, runs=9):
    rng = random.Random(seed)
    r, o = [], []
    for s in range(stores):
        for n in range(runs):
            status = "Failed" if rng.random() < 0.1 else None
            run = (f"s{s}r{n}", f"s{s}", T0 + timedelta(hours=12 * n), rng.random() < 0.7, status)
            r.append(run)
            for k in range(skus):
                for d in range(rng.choice([0, 0, 1, 1, 1, 2])):
                    promo = rng.choice(["None", "Special", "Special", "MemberPrice", "Multibuy"])
                    price = rng.choice(["3.00", "3.50", "4.00"])
                    was = rng.choice([None, None, "5.00"]) if promo == "Special" else None
                    o.append((f"s{s}", f"k{k}", run[0], len(o), price, promo, was, None, "2.00" if promo == "MemberPrice" else None, 2 if promo == "Multibuy" else None, "6.00" if promo == "Multibuy" else None))
    return o, r


def frames(spark, o, r):
    names = [c.split()[0] for c in OBS.split(", ")]
    kinds = [c.split(" ", 1)[1] for c in OBS.split(", ")]
    raw = spark.createDataFrame(o, ", ".join(f"{n} {'string' if k.startswith('decimal') else k}" for n, k in zip(names, kinds)))
    return raw.select(*[F.col(n).cast(k) for n, k in zip(names, kinds)]), spark.createDataFrame(r, RUNS)


def fold(o, r):
    """One observation after another."""
    state, snaps = {}, []
    for run_id, store, _, complete, status in sorted(r, key=lambda x: x[2]):
        if status == "Failed":
            continue
        seen = set()
        for x in (x for x in o if x[2] == run_id):
            key, price, promo, was = (x[0], x[1]), x[4], x[5], x[6]
            old = state.get(key)
            if promo == "Special" and was is None and old:
                on = old["tuple"][1] == "Special"
                was = old["tuple"][2] if on else (old["tuple"][0] if float(old["tuple"][0]) > float(price) else None)
            new = (price, promo, was, *x[8:])
            if old is None or old["tuple"] != new:
                snaps.append((run_id, *key, x[3], *new[:3]))
            state[key] = {"tuple": new, "misses": 0}
            seen.add(key)
        for key, s in state.items():
            if key[0] == store and key not in seen and complete:
                s["misses"] += 1
                if s["misses"] >= 2:
                    s["tuple"] = (s["tuple"][0], "None", None, None, None, None)
    return state, snaps


def text(x):
    return None if x is None else str(x)


def test_replay_equals_fold(spark):
    for seed in range(3):
        o, r = history(seed)
        obs, runs = frames(spark, o, r)
        state, snaps = fold(o, r)
        got = ingest.price_snapshots(obs, runs).collect()
        assert sorted((x.run_id, x.store_id, x.sku, x.seq, text(x.price), x.promo_type, text(x.was_price)) for x in got) == sorted(snaps, key=lambda s: s[:4])
        now = {(x.store_id, x.sku): (x.misses, text(x.price), x.promo_type, text(x.was_price)) for x in ingest.availability(obs, runs).collect()}
        assert now == {k: (s["misses"], *s["tuple"][:3]) for k, s in state.items()}


def described(obs):
    """Observations with names, a path of categories and tags that follow from their place."""
    k = F.col("seq")
    node = lambda kind, id_: F.struct(F.lit(kind).alias("kind"), id_.alias("external_id"), id_.alias("slug"), F.concat(id_, F.lit("-"), k).alias("name"))
    path = F.array(node("Department", F.concat(F.lit("d"), k % 2)), node("Aisle", F.concat(F.lit("a"), k % 5)))
    tag = F.struct(F.lit("Primary").alias("source"), F.concat(F.lit("t"), k % 3).alias("code"), F.concat(F.lit("l"), k).alias("label"))
    return obs.withColumns({"name": F.concat(F.lit("n"), k), "size": F.when(k % 3 > 0, F.concat(k, F.lit("g"))), "category_path": path, "tags": F.when(k % 4 > 0, F.array(tag)).otherwise(F.array().cast("array<struct<source: string, code: string, label: string>>"))})


def rows_of(df, *cols):
    return sorted((tuple(map(text, (r[c] for c in cols))) for r in df.select(*cols).collect()), key=str)


def test_stream_equals_replay(spark, tmp_path):
    o, r = history(7, stores=3, skus=4, runs=5)
    r += [(f"s0e{n}", "s0", T0 + timedelta(hours=100 + n), True, None) for n in range(2)]
    obs, runs = frames(spark, o, r)
    obs = described(obs)
    found = obs.groupBy("run_id").agg(F.count("*").cast("int").alias("products_found"))
    runs.join(found, "run_id", "left").fillna(0, ["products_found"]).withColumn("finished_at", F.expr("started_at + INTERVAL 5 MINUTES")).write.parquet(f"{tmp_path}/runs")
    stores = spark.createDataFrame([(f"s{i}", "NewWorld" if i else "Woolworths") for i in range(3)], "store_id string, chain string")
    stores.write.parquet(f"{tmp_path}/stores")
    # Every run's rows come in three files, so in three batches; the last one closes all runs of all stores at once.
    obs.repartition(3, "seq").write.parquet(f"{tmp_path}/obs")
    source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/obs")
    root = f"{tmp_path}/out"
    stream_ingest(source, root, f"{tmp_path}/runs", f"{tmp_path}/check", f"{tmp_path}/stores").awaitTermination()
    state, snaps = fold(o, r)
    now = read_state(spark, root).collect()
    assert {(x.store_id, x.sku): (x.misses, x.misses < 2, text(x.price), x.promo_type, text(x.was_price)) for x in now} == {k: (s["misses"], s["misses"] < 2, *s["tuple"][:3]) for k, s in state.items()}
    assert all(x.misses == 0 or x.missing_since for x in now) and {x.is_available for x in now if x.store_id == "s0"} == {False}
    got = read(spark, root, "snapshots").collect()
    assert sorted((x.run_id, x.store_id, x.sku, x.seq, text(x.price), x.promo_type, text(x.was_price)) for x in got) == sorted(snaps, key=lambda s: s[:4])
    apply_due(spark, root, f"{tmp_path}/runs", f"{tmp_path}/stores")
    assert closed_runs(spark, root).count() == len(r) and closed_runs(spark, root).where("finished_at is null").count() == 0
    # Names, times, categories and tags as by the replay.
    times = ("store_id", "sku", "name", "size", "first_seen_at", "last_seen_at", "price_updated_at", "missing_since")
    assert rows_of(read_state(spark, root), *times) == rows_of(ingest.availability(obs, runs, ("name", "size")), *times)
    link = ("store_id", "sku", "kind", "external_id")
    assert rows_of(read(spark, root, "links"), *link) == rows_of(ingest.product_category_links(obs, runs), *link)
    tags, tag_links = ingest.sync_tags(obs, runs, stores)
    assert rows_of(read(spark, root, "tags"), "chain", "source", "code", "label") == rows_of(tags, "chain", "source", "code", "label")
    assert rows_of(read(spark, root, "tag_links"), "store_id", "sku", "source", "code") == rows_of(tag_links, "store_id", "sku", "source", "code")
    nodes = ingest.upsert_store_categories(obs.join(ingest.numbered_runs(runs).select("run_id", "run_no"), "run_id"))
    node = ("store_id", "kind", "external_id", "name", "parent_external_id")
    assert rows_of(read(spark, root, "store_categories"), *node) == rows_of(nodes, *node)
    assert not [r for b in Versions(spark, root).names(f"{root}/inbox") for r in Versions(spark, root).names(f"{root}/inbox/{b}") if r.startswith("r=")]


def test_runs_in_any_parts_equal_the_replay(spark):
    """Runs applied one by one, in pairs or all at once, with links and tags merged on the way."""
    o, r = history(11, stores=2, skus=4, runs=6)
    obs, runs = frames(spark, o, r)
    obs = described(obs).cache()
    stores = spark.createDataFrame([("s0", "a"), ("s1", "b")], "store_id string, chain string")
    cols = (*ingest.STATE, "name")
    want = rows_of(ingest.availability(obs, runs, ("name",)), *cols)
    links, (tags, tag_links) = ingest.product_category_links(obs, runs), ingest.sync_tags(obs, runs, stores)
    for step in (2, 4):
        some = lambda a, b: runs.where(F.substring("run_id", 4, 9).cast("int").between(a, b - 1))
        state = ingest.availability(obs, some(0, 0), ("name",)).select(*cols)
        kept, held = ingest.product_category_links(obs, some(0, 0)), ingest.sync_tags(obs, some(0, 0), stores, times=True)
        for a in range(0, 6, step):
            new = some(a, a + step)
            mine = obs.join(new.select("run_id"), "run_id", "left_semi")
            state = spark.createDataFrame(ingest.apply_runs(state, mine, new, ("name",))[0].collect(), state.schema)
            kept = spark.createDataFrame(ingest.merge_category_links(kept, mine, new).collect(), links.schema)
            held = [spark.createDataFrame(x.collect(), y.schema) for x, y in zip(ingest.merge_tags(*held, mine, new, stores), held)]
        assert rows_of(state, *cols) == want
        assert rows_of(kept, *links.columns) == rows_of(links, *links.columns)
        assert rows_of(held[0], "chain", "code", "label") == rows_of(tags, "chain", "code", "label") and rows_of(held[1], *tag_links.columns) == rows_of(tag_links, *tag_links.columns)


def test_a_failure_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "store_id string, n long")
    schema = "store_id string, n long"
    assert read_parts(spark, root, "t", schema).count() == 0
    replace_parts(spark, root, "t", df)
    before = (tmp_path / "t/t/version=1" / f"part={part_name('b')}").stat().st_mtime_ns

    def fails(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", fails)
        try:
            replace_parts(spark, root, "t", df.where("store_id = 'a'").withColumn("n", F.lit(9).cast("long")))
        except RuntimeError:
            pass
    assert sorted(x.n for x in read_parts(spark, root, "t", schema).collect()) == [1, 2, 3]
    assert replace_parts(spark, root, "t", df.where("store_id = 'a'").withColumn("n", F.lit(7).cast("long"))) == 2
    assert sorted(x.n for x in read_parts(spark, root, "t", schema).collect()) == [2, 3, 7]
    # One store's folder was written, the others are where they were.
    assert len(list((tmp_path / "t/t/version=2").glob("part=*"))) == 1 and (tmp_path / "t/t/version=1" / f"part={part_name('b')}").stat().st_mtime_ns == before
    Versions(spark, root).prune(1)
    assert sorted(x.n for x in read_parts(spark, root, "t", schema).collect()) == [2, 3, 7] and not (tmp_path / "t/t/version=1" / f"part={part_name('a')}").exists()
    assert Version().held == {}


def test_a_run_waits_for_all_its_rows(spark, tmp_path):
    o = [("s", "a", "r1", n, "3.00", "None", None, None, None, None, None) for n in range(2)]
    obs, runs = frames(spark, o, [("r1", "s", T0, True, None), ("r2", "s", T0 + timedelta(hours=1), True, None)])
    runs.withColumn("products_found", F.when(F.col("run_id") == "r1", 2).otherwise(0)).write.parquet(f"{tmp_path}/runs")
    run = apply_batch(f"{tmp_path}/out", f"{tmp_path}/runs")
    run(obs.where("seq = 0"), 0)
    assert read_state(spark, f"{tmp_path}/out").count() == 0
    for _ in range(2):  # a batch that is repeated changes nothing
        run(obs.where("seq = 1"), 1)
        assert [x.misses for x in read_state(spark, f"{tmp_path}/out").collect()] == [1]


def test_runs_close(spark):
    o, r = history(1)
    obs, runs = frames(spark, o, r)
    runs = runs.withColumn("gaps", F.array(F.repeat(F.lit("x"), 1500), F.repeat(F.lit("y"), 1500)))
    rows = ingest.close_crawl_runs(obs, ingest.price_snapshots(obs, runs), runs).collect()
    assert all(len(x.error_message) == 2000 for x in rows)
    assert {x.status for x in rows} <= {"Succeeded", "Partial", "Failed"} and sum(x.snapshots_written for x in rows) == ingest.price_snapshots(obs, runs).count()


def test_ranges_of_long_histories_equal_whole_listings(spark):
    """Two listings of many hundred observations over ranges of about 100 rows."""
    for seed in (1, 2):
        o, r = history(seed, stores=1, skus=2, runs=400)
        obs, runs = frames(spark, o, r)
        names = ["store_id", "sku", "run_id", "seq", "promo_type", "was_price", "changed"]
        plain = ingest.reconstruct_was_price(obs, runs).select(*names)
        parts = ingest.reconstruct_was_price(obs, runs, scratch_keep(spark), len(o) // 100).select(*names)
        rows = lambda df: sorted(tuple(map(text, x)) for x in df.collect())
        assert rows(parts) == rows(plain) and len(o) > 500
    small = frames(spark, *history(3))
    assert rows(ingest.price_snapshots(*small, scratch_keep(spark), 9)) == rows(ingest.price_snapshots(*small))
    assert ingest.price_snapshots(small[0].limit(0), small[1], scratch_keep(spark)).count() == 0


def test_prices_as_of_in_ranges(spark):
    rng = random.Random(6)
    at = lambda: T0 + timedelta(minutes=rng.randrange(5000))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    moments = sorted({at() for _ in range(900)})
    snaps = spark.createDataFrame([(rng.choice(["hot", "b"]) if i % 9 else "c", m, rng.choice(["1.00", "2.00", None])) for i, m in enumerate(moments)], "product_id string, captured_at timestamp, price string")
    asked = spark.createDataFrame([(i, key(), at()) for i in range(500)], "q long, product_id string, at timestamp")
    rows = lambda df: sorted(tuple(map(str, x)) for x in df.collect())
    ranged = prices.price_as_of(asked, snaps, scratch_keep(spark), 13)
    assert rows(ranged) == rows(prices.price_as_of(asked, snaps)) and ranged.where("since is not null").count() > 300

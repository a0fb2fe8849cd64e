"""Histories in tasks that do not grow with the table."""

from pyspark.sql import functions as F

from pricelake.operators import history, ranges
from pricelake.sources.tables import scratch_keep


def test_tasks_of_promo_windows_follow_the_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 500).cast("string").alias("product_id"), F.timestamp_seconds("id").alias("captured_at"), F.when(F.col("id") % 3 == 0, "None").otherwise("Special").alias("promo_type"), F.lit(1).cast("decimal(10,2)").alias("price"))
    few, many = history.promo_windows(rows), history.promo_windows(rows, 20 * history.ROWS_A_TASK)
    assert many.select(F.spark_partition_id()).distinct().count() == 20
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_only_keys_at_the_end_of_a_range_are_grouped(spark):
    # 300 short keys and one long key, over eight ranges.
    rows = spark.range(3000).select(F.when(F.col("id") < 300, F.col("id") + 1000).otherwise(F.lit(1150)).cast("string").alias("k"), F.col("id").alias("at"), F.struct(F.col("id").alias("v")).alias("value"))
    dealt = ranges.ranged(rows, ["k"], ["at"], scratch_keep(spark), 8)
    carried = ranges._carried(dealt, ["k"], ["at"], F.col("value"))
    held = dealt.where("k = '1150'").groupBy("range_").agg(F.max("at").alias("v")).orderBy("range_").collect()
    want = [(b.range_, "1150", a.v) for a, b in zip(held[:-1], held[1:], strict=True)]
    assert sorted((r.range_, r.k, r.carry_.v) for r in carried.collect()) == want and len(want) > 3
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan

"""op4's fit takes in every labelled row that is not held out."""

import numpy as np
from pyspark.sql import functions as F

from pricelake.llm import quality
from pricelake.llm.common import Scratch


def test_steps_pairs_and_cut_come_from_all_rows(spark):
    # Over 5,000 rows of each label; a third of the ids is of the rarer one.
    rows = spark.range(18_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("label"))
    x = F.array(F.col("doc_id").cast("float"), *[F.lit(0.0).cast("float")] * 19)
    rows = Scratch(spark, "rows").keep(rows.withColumn("x", x))
    q = quality.quantiles(rows)[:, 0]
    assert np.allclose(q, np.linspace(0, 17_999, quality.STEPS), rtol=1e-3)
    told = quality.pairs(rows, 6000)
    assert told.select(F.col("good")[0]).distinct().count() == 12_000 and told.select(F.col("bad")[0]).distinct().count() == 6000
    r = quality.Ranker(quality.quantiles(rows))
    r.weight[:] = 0
    r.weight.reshape(quality.STEPS - 1, -1)[:, 0] = 1
    quality.calibrate(rows, r, 1 / 3)
    assert rows.where(F.col("doc_id") < 6000).count() == 6000 and abs(float(r.raw(np.eye(1, 20) * 6000)[0]) - r.cut) < 1e-2


def test_fit_reads_all_labelled_rows(spark):
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "A b c. A d.").otherwise("## ## ##").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    rows = quality.labelled(docs, labels, 4, 2)
    assert rows.count() == labels.where(~quality.held_out(F.col("doc_id"), 4, 2)).count() > 10_000

"""The bounds of languages come from all training texts."""

import random

import numpy as np

from pricelake.llm import language_id
from pricelake.llm.common import Scratch


def test_bounds_come_from_all_training_texts(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    rows = [(i, " ".join(word("abcdef" if i % 3 else "uvwxyz") for _ in range(rng.randrange(1, 9))), "aa" if i % 3 else "uu") for i in range(1200)]
    # One text that is unlike the others moves the deviation of its language.
    docs = spark.createDataFrame([*rows, (5000, "qqqqjjjj " * 40, "aa"), (5001, "123", "aa"), (5002, None, "aa")], "doc_id long, text string, lang string")
    m = language_id.train(spark, docs)
    each = language_id.entropies(spark, docs.select("text", "lang").where("text is not null"), m, Scratch(spark, "t")).where("some").collect()
    for i, lang in enumerate(m.langs):
        nats = [r.nats[i] for r in each if r.lang == lang]
        assert len(nats) == sum(r[2] == lang for r in rows) + (lang == "aa")
        assert abs(m.mean[i] - np.mean(nats)) < 1e-9 and abs(m.deviation[i] - max(np.std(nats), 0.02)) < 1e-9

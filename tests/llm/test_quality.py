from __future__ import annotations

import numpy as np

from lodestrata.llm import quality
from lodestrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = QUERIES["op3_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found["predicted"] == found["quality"]).mean() > 0.95
    rows = scored.toPandas()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.7)).all() and len(rows) == 1000


def test_a_score_is_a_sparse_dot_product(spark):
    import pyarrow as pa

    weights = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1)
    texts = ["a b a", "", "Alle Meine ENTCHEN!! ###"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    for k, text in enumerate(texts):
        found, first = quality.features(pa.array([text]))
        x = np.bincount(found, minlength=1 << quality.BITS) * quality.SCALE / max(1, len(found))
        assert abs(got[k] - 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1])))) < 1e-5


def test_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, "t"), (1, 0, "t"), (5, 1, "t"), (None, 1, "t"), (6, None, "t"), (99, 0, "t")], "doc_id long, quality int, text string")
    assert quality.classify(hard, labels).count() == hard.count()
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(hard, labels.limit(0)).collect()} == {0.5}


def test_updates_are_those_of_the_published_rule():
    """FTRL-proximal as published, one coordinate at a time in plain Python."""
    import math

    import numpy as np

    from lodestrata.llm import quality

    draw = np.random.default_rng(1)
    model, z, n = quality.FollowTheLeader(bits=4), [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(300):
        at = np.sort(draw.choice(17, int(draw.integers(1, 6)), replace=False))
        values, label = draw.random(len(at)), int(draw.integers(2))
        own = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(w * x for w, x in zip(own, values))))
        for i, w, x in zip(at, own, values):
            g = (p - label) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w
            n[i] += g * g
        model.update(at, values, label)
    assert np.allclose(model.weights(), [weight(i) for i in range(17)])

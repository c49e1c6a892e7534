import numpy as np

from tessera.operators import ml


def test_a_pass_over_the_rows_serves_all_starts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "node long, features array<double>").coalesce(2)
    passes, summed = [], ml.summed
    monkeypatch.setattr(ml, "summed", lambda *a: passes.append(1) or summed(*a))
    got = {r["node"]: r["cluster"] for r in ml.kmeans(rows, 3, rounds=4).collect()}
    assert len({tuple(sorted({got[i] for i in range(s, s + 30)})) for s in (0, 30, 60)}) == 3 and len(set(got.values())) == 3
    assert len(passes) <= 2 + 4  # mean, variance and one for each round

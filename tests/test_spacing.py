import math
import random
import statistics

import pytest

from tessera.errors import ContractError
from tessera.operators import spacing


def brute(points):
    return [min(math.dist(p, q) for j, q in enumerate(points) if i != j) for i, p in enumerate(points)]


def clumps(rng):
    """One crowd in a tiny square, a few far places, a line and repeats."""
    out = [(5 + rng.random() * 1e-6, 5 + rng.random() * 1e-6) for _ in range(150)]
    out += [(rng.random() * 1000, rng.random() * 1000) for _ in range(40)] + [(float(i), 0.0) for i in range(30)]
    return out + out[:20] + [(-1e5, 7.0)] * 3


@pytest.mark.parametrize(("crowd", "make"), [(spacing.CROWD, clumps), (4, lambda r: [(r.random(), 0.0) for _ in range(33)] + [(9.0, 9.0)]), (spacing.CROWD, lambda r: [(1.0, 1.0)] * 5)])
def test_against_all_pairs(spark, monkeypatch, crowd, make):
    monkeypatch.setattr(spacing, "CROWD", crowd)
    points = make(random.Random(3))
    df = spark.createDataFrame(points, "x double, y double")
    rows, n = spacing.nearest_distances(df)
    got = {}
    for r in rows.collect():
        got[r["x"], r["y"]] = r["distance"]
    want = brute(points)
    assert n == len(points) and all(got[p] == pytest.approx(w, rel=1e-12) for p, w in zip(points, want, strict=True))
    one = spacing.nearest_neighbour_ratio(df, 2.0).first()
    assert one["median"] == pytest.approx(statistics.median(want), rel=1e-12)
    assert one["ratio"] == pytest.approx(statistics.median(want) / (2 * math.sqrt(1 / n)), rel=1e-12)


def test_refusals(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "x double, y double")
    with pytest.raises(ContractError, match="at least two"):
        spacing.nearest_neighbour_ratio(df((1.0, 2.0)))
    with pytest.raises(ContractError, match="at least two"):
        spacing.nearest_neighbour_ratio(df())
    with pytest.raises(ContractError, match="no finite"):
        spacing.nearest_neighbour_ratio(df((1.0, None), (2.0, float("nan")), (0.0, 0.0)))
    for spread in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ContractError, match="spread"):
            spacing.nearest_neighbour_ratio(df((1.0, 2.0), (3.0, 4.0)), spread)

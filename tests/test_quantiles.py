from __future__ import annotations

import numpy as np
import pytest

from packetloom.operators import quantiles
from packetloom.operators.quantiles import exact_percentile, exact_percentiles

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


def samples():
    draw = np.random.default_rng(5)
    yield "uniform", draw.random(5000)
    yield "ties", np.r_[np.zeros(2000), draw.integers(0, 5, 2000), np.full(1000, 4.0)]
    yield "skewed", np.exp(draw.normal(0, 4, 3001))
    yield "constant", np.full(700, 3.5)
    yield "single", np.array([2.0])
    yield "two", np.array([1.0, 2.0])


@pytest.mark.parametrize("gather", [5, 400, 1_000_000])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_against_numpy(spark, monkeypatch, gather, accuracy):
    monkeypatch.setattr(quantiles, "GATHER_ROWS", gather)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    chosen = list(samples()) if gather == 400 else list(samples())[1:3]
    for name, values in chosen:
        df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").repartition(3)
        found = exact_percentiles(df, {"v": FRACTIONS})
        for p in FRACTIONS:
            assert found["v", p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12), (name, p)


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a DOUBLE, b DOUBLE")
    found = exact_percentiles(df, {"a": [0.5], "b": [0.5]})
    assert found == {("a", 0.5): 2.0, ("b", 0.5): None}
    assert exact_percentile(df, "a", 1.0) == 3.0

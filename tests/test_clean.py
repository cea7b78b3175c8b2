from __future__ import annotations

import math
from decimal import Decimal

import pytest

from packetloom.operators.clean import (
    attach_label,
    clean_features,
    invalid_counts,
    numeric_violations,
    require_numeric,
)

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(1.0, INF, "s", "d"), (2.0, 2.0, "s", "d"), (NAN, 3.0, "s", "d"), (NAN, -INF, "s", "d")]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, src STRING, dst STRING")


def test_clean(dirty):
    out = clean_features(dirty)
    assert out.columns == ["a", "b"]
    assert sorted(tuple(r) for r in out.collect()) == [(0.0, 3.0), (1.0, 0.0), (2.0, 2.0)]


def test_result_does_not_depend_on_batches(dirty):
    whole = clean_features(dirty.repartition(1)).collect()
    parts = clean_features(dirty.repartition(4)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_casts(spark):
    df = spark.createDataFrame([(Decimal("1.5"), "2", "x")], "d DECIMAL(9,2), t STRING, u STRING")
    row = clean_features(df, ["d", "t", "u"]).first()
    assert (row.d, row.t, row.u) == (1.5, 2.0, 0.0)


def test_label(dirty):
    assert attach_label(dirty, None).columns == dirty.columns
    assert {r.label for r in attach_label(dirty, 0).collect()} == {0}


def test_invalid_counts(dirty):
    rows = {r.column_name: tuple(r)[1:] for r in invalid_counts(dirty, ["a", "b"]).collect()}
    assert rows == {"a": (0, 2, 0), "b": (0, 0, 2)}


def test_numeric_check(spark):
    df = spark.createDataFrame([("1", "x"), ("NaN", "2"), (None, "n/a"), (" 3.5 ", "1e3")], "a STRING, b STRING")
    assert {r.column_name: r.n_violations for r in numeric_violations(df, ["a", "b"]).collect()} == {"a": 0, "b": 1}
    assert [r.a for r in require_numeric(df, ["a"]).collect()] == [1.0, None, None, 3.5]
    with pytest.raises(ValueError, match=r"b \(1\)"):
        require_numeric(df, ["a", "b"])
    assert not math.isnan(require_numeric(df, ["a"]).first().a)

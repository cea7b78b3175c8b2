from __future__ import annotations

import numpy as np
import pytest

from packetloom.operators import metrics as M
from packetloom.operators.scaling import Scaler, fit_scaler, scale, scaler_stats

TRUE, PREDICTED = [0, 0, 0, 1, 1, 1], [0, 0, 1, 0, 1, 1]


@pytest.fixture(scope="module")
def judged(spark):
    scores = [0.1, 0.2, 0.8, 0.2, 0.8, 0.9]
    return spark.createDataFrame(list(zip(TRUE, PREDICTED, scores)), "label INT, prediction INT, score DOUBLE")


def test_confusion_matrix(judged):
    cells = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(judged).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    assert {r.n for r in M.confusion_matrix(judged.filter("label = 0 and prediction = 0")).collect()} == {0, 2}


def test_binary_metrics(judged):
    assert M.binary_metrics(judged).first().asDict() == pytest.approx(
        {"accuracy": 4 / 6, "precision": 2 / 3, "recall": 2 / 3, "f1_score": 2 / 3}
    )
    none = M.binary_metrics(judged.filter("label = 0").selectExpr("label", "0 as prediction")).first()
    assert (none.accuracy, none.precision, none.recall, none.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_auc_counts_ties_half(judged):
    pairs = [(a, b) for t, a in zip(TRUE, [0.1, 0.2, 0.8, 0.2, 0.8, 0.9]) for b in [0.2, 0.8, 0.9] if t == 0]
    wanted = np.mean([1.0 if b > a else 0.5 if a == b else 0.0 for a, b in pairs])
    assert M.roc_auc(judged) == pytest.approx(wanted)
    assert M.roc_auc(judged.filter("label = 1")) is None


def test_auc_over_many_ranges(spark):
    draw = np.random.default_rng(8)
    score, label = np.round(draw.normal(0, 1, 4000), 2), draw.integers(0, 2, 4000)
    score[:1500] = 0.25  # one score holds a third of the rows
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score DOUBLE, label INT")
    pos, neg = score[label == 1], score[label == 0]
    wanted = (np.sum(pos[:, None] > neg) + np.sum(pos[:, None] == neg) / 2) / (len(pos) * len(neg))
    assert M.roc_auc(df.repartition(5)) == pytest.approx(wanted, rel=1e-12)


def test_report(judged):
    rows = {r["class"]: r for r in M.classification_report(judged.unionByName(judged.filter("label = 1"))).collect()}
    assert rows["1"].support == 6 and rows["1"].recall == pytest.approx(4 / 6)
    assert rows["0"].precision == pytest.approx(2 / 4)
    assert rows["accuracy"].precision == pytest.approx(6 / 9)
    assert rows["macro avg"].recall == pytest.approx(2 / 3)
    assert rows["weighted avg"].precision == pytest.approx((0.5 * 3 + 0.8 * 6) / 9)


def test_errors(spark):
    draw = np.random.default_rng(1)
    mse, label = draw.random(200), draw.integers(0, 2, 200)
    rows = [(float(m), float(m) / 2, int(y), int(m > 0.5)) for m, y in zip(mse, label)]
    df = spark.createDataFrame(rows, "mse DOUBLE, mae DOUBLE, label INT, prediction INT")
    found = M.evaluate_errors(df, "label")
    assert found["mse_mean"] == pytest.approx(mse.mean()) and found["mse_std"] == pytest.approx(mse.std())
    assert found["mse_p95"] == pytest.approx(np.percentile(mse, 95))
    assert found["mae_iqr"] == pytest.approx((np.percentile(mse, 75) - np.percentile(mse, 25)) / 2)
    assert found["avg_mse_anomalous"] == pytest.approx(mse[label == 1].mean())
    assert "mae_p95" not in found and 0 <= found["roc_auc"] <= 1
    assert set(M.evaluate_errors(df)) == {k for k in found if k.startswith(("mse_", "mae_"))}
    one = M.error_by_class(df.filter("label = 0")).first()
    assert one.avg_mse_anomalous is None and one.avg_mse_normal is not None


def test_fold_summary(spark):
    rows = [(0, "f1", 0.5), (1, "f1", 0.7), (2, "f1", 0.9), (0, "auc", None), (1, "auc", 0.5), (0, "acc", 1.0), (1, "acc", None)]
    df = spark.createDataFrame(rows, "fold INT, metric STRING, value DOUBLE")
    found = {r.metric: (r["mean"], r["std"]) for r in M.fold_summary(df).collect()}
    assert found["f1"] == pytest.approx((0.7, np.std([0.5, 0.7, 0.9])))
    assert found["acc"] == (1.0, 0.0) and "auc" not in found


def test_comparison_and_top(spark):
    rows = [("a", "accuracy", 0.123456, None), ("a", "roc_auc", None, None), ("b", None, None, "boom")]
    out = {r.model: r for r in M.comparison_table(spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE, error STRING")).collect()}
    assert out["a"].accuracy == 0.1235 and out["a"].roc_auc is None and out["b"].error == "boom"
    best = M.top_features(spark.createDataFrame([("x", 0.1), ("z", 0.5), ("y", 0.5)], "feature STRING, importance DOUBLE"), 2)
    assert [r.feature for r in best.collect()] == ["y", "z"]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "b")], "u DOUBLE, v DOUBLE, t STRING")
    scaler = fit_scaler(df, ["u", "v"])
    assert (scaler.means, scaler.stds, scaler.rows) == ((2.0, 5.0), (1.0, 1.0), 2)
    assert [(r.u, r.v) for r in scale(df, scaler).orderBy("t").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert {r.feature: r["std"] for r in scaler_stats(df, ["u", "v"]).collect()} == {"u": 1.0, "v": 0.0}
    again = Scaler.from_frame(scaler.to_frame(spark))
    assert (again.means, again.features) == (scaler.means, scaler.features)
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="u"):
            fit_scaler(df.unionByName(spark.createDataFrame([(bad, 1.0, "c")], df.schema)), ["u", "v"])
    with pytest.raises(ValueError):
        fit_scaler(df.limit(0), ["u"])

from __future__ import annotations

import json

import pytest
from packets import ethernet, ip4, pcap, tcp

from packetloom.models.forest import RandomForestModel
from packetloom.plans.detect import detect, detect_file
from packetloom.plans.train import compare_models, cross_validate, train_model

SMALL = {"autoencoder": {"epochs": 2}, "random_forest": {"trees": 5}, "svm": {"max_iter": 5}}


def test_train(spark, labelled, labelled_rows, tmp_path):
    labelled_rows.to_csv(tmp_path / "in.csv", index=False)
    out = str(tmp_path / "model")
    model, metrics = train_model(spark, "random_forest", str(tmp_path / "in.csv"), out, trees=5)
    assert model.training_rows == 20 and model.training_dataset.endswith("in.csv")
    assert set(metrics) == {"accuracy", "precision", "recall", "f1_score", "roc_auc"}
    train_model(spark, "autoencoder", labelled, out, epochs=2)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("model")]) == 2  # never replaced
    _, unlabelled = train_model(spark, "autoencoder", labelled.drop("label"), out, epochs=1)
    assert "mse_mean" in unlabelled and "accuracy" not in unlabelled


def test_train_refuses_unusable_input(spark, labelled, tmp_path):
    out = str(tmp_path / "model")
    assert train_model(spark, "svm", str(tmp_path / "missing.csv"), out) is None
    assert train_model(spark, "svm", labelled.drop("label"), out) is None
    assert train_model(spark, "autoencoder", labelled.limit(0), out) is None
    (tmp_path / "empty.csv").write_text("")
    assert train_model(spark, "autoencoder", str(tmp_path / "empty.csv"), out) is None
    with pytest.raises(ValueError):
        train_model(spark, "unheard_of", labelled, out)


def test_cross_validation(spark, labelled):
    out = {r.metric: r for r in cross_validate(spark, "random_forest", labelled, k=3, trees=5).collect()}
    assert set(out) == {"accuracy", "precision", "recall", "f1_score", "roc_auc"}
    assert all(0 <= r["mean"] <= 1 and r["std"] >= 0 and r.k == 3 and r.model == "random_forest" for r in out.values())
    ae = {r.metric for r in cross_validate(spark, "autoencoder", labelled, k=2, epochs=1).collect()}
    assert {"mse_mean", "mae_iqr"} <= ae
    assert cross_validate(spark, "svm", labelled.drop("label")) is None


def test_comparison(spark, labelled, tmp_path):
    out = compare_models(spark, labelled, str(tmp_path / "cmp"), models=("autoencoder", "random_forest", "svm", "none_such"), parameters=SMALL)
    rows = {r.model: r for r in out.collect()}
    assert set(rows) == {"autoencoder", "random_forest", "svm", "none_such"}
    for name in SMALL:
        assert rows[name].error is None and 0 <= rows[name].accuracy <= 1
    assert rows["none_such"].accuracy is None and "unknown model" in rows["none_such"].error
    shown = spark.read.csv(str(tmp_path / "cmp" / "results.csv"), header=True).collect()
    assert {r.error for r in shown if r.model == "svm"} == {"N/A"}
    assert compare_models(spark, labelled.drop("label")) is None


@pytest.fixture(scope="module")
def forest(spark):
    rows = [(i, 9 - i, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "f1 INT, f2 INT, label INT")
    return RandomForestModel(trees=5).fit(df), df


def test_detection(spark, forest, tmp_path):
    model, df = forest
    stored, found = detect(spark, model, df.selectExpr("*", "'x' as src"), "m", str(tmp_path / "out.csv"), alert_path=str(tmp_path / "al"))
    assert stored.columns == ["f1", "f2", "prediction"] and stored.count() == 20
    alerts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "al")).collect()]
    assert len(alerts) == found == stored.filter("prediction = 1").count() > 0
    assert {a["model"] for a in alerts} == {"m"} and {a["anomaly_score"] for a in alerts} == {None}
    empty, none = detect(spark, model, df.limit(0), "m", str(tmp_path / "none.csv"))
    assert none == 0 and not (tmp_path / "none.csv").exists()


def test_detection_on_files(spark, forest, tmp_path):
    model, df = forest
    path = model.save(spark, str(tmp_path / "m1"))
    (tmp_path / "in.csv").write_text("f1,f2,label\n1,8,0\n2,7,1\n")
    stored, _ = detect_file(spark, "random_forest", path, str(tmp_path / "in.csv"), str(tmp_path / "o.csv"))
    assert stored.count() == 2 and "prediction" in stored.columns
    (tmp_path / "bad.csv").write_text("")
    assert detect_file(spark, "random_forest", path, str(tmp_path / "bad.csv"), str(tmp_path / "o.csv")) is None
    assert detect_file(spark, "random_forest", path, str(tmp_path / "in.xls"), str(tmp_path / "o.csv")) is None
    packets = [(1_000_000 * i + 1, ethernet(0x0800, ip4(6, tcp(sport=i)))) for i in range(5)]
    (tmp_path / "a.pcap").write_bytes(pcap(packets))
    assert detect_file(spark, "random_forest", path, str(tmp_path / "a.pcap"), str(tmp_path / "o.csv")) is None

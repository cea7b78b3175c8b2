from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from packetloom.operators.alerts import ALERT_FIELDS, project_alerts, render_alerts
from packetloom.plans.extract import load_input
from packetloom.plans.prepare import combine_sources, prepare_dataset
from packetloom.session import checkpoint_root, checkpointed, materialize, release_scratch, scratch_path
from packetloom.sources.paths import path_exists, unused_path
from packetloom.sources.sinks import _append_lines, read_alerts, read_document, write_alerts, write_document, write_table
from packetloom.sources.tabular import load_dataset, with_source_name


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_file_and_directory(spark, tmp_path):
    one = put(tmp_path / "one.csv", "a,b,label\n1,2,0\n3,4,1\n")
    df = load_dataset(spark, one, infer=True)
    assert df.columns == ["a", "b", "label"] and df.count() == 2 and dict(df.dtypes)["a"] == "int"
    put(tmp_path / "two.csv", "b,a,c,label\n7,8,9,1\n")
    put(tmp_path / "note.txt", "no table")
    (tmp_path / "inner").mkdir()
    put(tmp_path / "inner" / "deep.csv", "a,b,label\n0,0,0\n")
    both = load_dataset(spark, str(tmp_path))
    assert {(r.a, r.b, r.c, r.label) for r in both.collect()} == {("1", "2", None, 0), ("3", "4", None, 1), ("8", "7", "9", 1)}
    assert {r.source for r in with_source_name(load_dataset(spark, one)).collect()} == {"one.csv"}
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        load_dataset(spark, put(tmp_path / "empty.csv", ""))


def test_declared_packet_columns_have_types(spark, tmp_path):
    df = load_dataset(spark, put(tmp_path / "p.csv", "timestamp,tcp_seq,label\n1.5,4294967295,1\n"))
    assert dict(df.dtypes) == {"timestamp": "double", "tcp_seq": "bigint", "label": "int"}
    loose = load_dataset(spark, put(tmp_path / "q.csv", "tcp_sport,tcp_seq,length\n80.0,4294967295.0,word\nNA,,7\n"))
    assert [tuple(r) for r in loose.collect()] == [(80, 4294967295, None), (None, None, 7)]


def test_numbers_only(spark, tmp_path):
    path = put(tmp_path / "p.csv", "tcp_sport,x,src\n80.0,1.5,10.0.0.1\n,NaN,10.0.0.2\n")
    df = load_input(spark, path)
    assert [tuple(r) for r in df.select("tcp_sport", "x", "src").collect()] == [(80, 1.5, "10.0.0.1"), (None, None, "10.0.0.2")]
    with pytest.raises(ValueError, match="tcp_sport"):
        load_input(spark, put(tmp_path / "bad.csv", "tcp_sport,x\nhttp,1\n"))


def test_combine_files(spark, tmp_path):
    a = put(tmp_path / "a.csv", "a,b,label\n1,2,0\n")
    b = put(tmp_path / "b.csv", "a,b,label\n1.0,2,0\n5,,1\n")
    out = combine_sources(spark, [a, b, str(tmp_path / "missing.csv"), put(tmp_path / "e.csv", "")])
    assert sorted((r.a, r.b, r.label) for r in out.filter("b is not null").collect()) == [(1.0, 2.0, 0)]
    assert out.count() == 2
    assert combine_sources(spark, [str(tmp_path / "missing.csv")]).columns == []
    with pytest.raises(ValueError, match="b"):
        combine_sources(spark, [a, put(tmp_path / "bad.csv", "a,b,label\n1,word,0\n")])


def test_prepare(spark, tmp_path):
    rows = "".join(f"{i},{int(i % 3 == 0)}\n" for i in range(60))
    source = put(tmp_path / "in.csv", "a,label\n" + rows)
    out = str(tmp_path / "set.csv")
    written = prepare_dataset(spark, out, [source], balance=True, split=True)
    counts = {k: spark.read.csv(p, header=True).count() for k, p in written.items()}
    assert counts == {"combined": 60, "balanced": 40, "train": 32, "test": 8}
    again = prepare_dataset(spark, out, [source])
    assert again["combined"] != out and spark.read.csv(out, header=True).count() == 60
    assert prepare_dataset(spark, out, table=spark.range(1)) == {}


def test_paths_and_documents(spark, tmp_path):
    path = str(tmp_path / "table.csv")
    assert unused_path(spark, path) == path
    assert write_table(spark.range(3), path) == path
    now = datetime(2024, 5, 6, 7, 8, 9)
    assert unused_path(spark, path, now).endswith("table_20240506_070809_1.csv")
    assert write_table(spark.range(3), path) != path
    document = {"a": [1, {"b": None}], "t": "é"}
    write_document(spark, document, str(tmp_path / "doc"))
    assert read_document(spark, str(tmp_path / "doc")) == document


def test_lineage_helpers(spark):
    df = spark.range(10).repartition(3)
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = materialize(df)
    assert stored.dtypes == df.dtypes and stored.count() == 10
    assert checkpointed(df).rdd.getNumPartitions() == 3
    assert path_exists(spark, scratch_path(spark))
    release_scratch(spark)
    assert not path_exists(spark, scratch_path(spark))


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, 443, 0, 9, 6, 0.5, 1_700_000_000.123456),
        (1, 0, 53, 0, 17, 0.25, 0.0),
        (1, None, None, None, None, None, None),
        (0, 1, 1, 1, 6, 0.1, 5.0),
    ]
    return spark.createDataFrame(
        rows, "prediction INT, tcp_sport INT, udp_sport INT, udp_dport INT, ip_proto_number INT, anomaly_score DOUBLE, timestamp DOUBLE"
    )


NOW = "2024-06-01 12:30:00"


def test_alert_fields(scored):
    rows = project_alerts(scored, "m1", "svm").collect()
    assert len(rows) == 3 and rows[0].__fields__ == list(ALERT_FIELDS)
    by_score = {r.anomaly_score: r for r in rows}
    assert (by_score[0.5].source_port, by_score[0.5].destination_port) == (443, 9)
    assert (by_score[0.25].source_port, by_score[0.25].destination_port, by_score[0.25].timestamp) == (53, 0, None)
    assert by_score[None].source_port is None and by_score[None].protocol is None


def test_alert_text(scored):
    now = F.lit(NOW).cast("timestamp")
    rows = render_alerts(project_alerts(scored, "m1", "svm"), "box", now).collect()
    parsed = [json.loads(r.json) for r in rows]
    assert all(list(p) == list(ALERT_FIELDS) for p in parsed)
    assert sorted(str(p["timestamp"]) for p in parsed) == ["1700000000.123456", *["2024-06-01T12:30:00.000000+00:00"] * 2]
    assert {p["classification"] for p in parsed} == {"anomaly"}
    for r in rows:
        assert r.syslog == f"<14>1 2024-06-01T12:30:00Z box packetloom - - - {r.json}"


def test_alert_delivery(spark, scored, tmp_path):
    alerts = project_alerts(scored, "m1", "svm")
    lines, logs = str(tmp_path / "lines"), str(tmp_path / "logs")
    assert write_alerts(alerts, lines, logs, "both", dry_run=True)
    assert not (tmp_path / "lines").exists()
    assert write_alerts(alerts, lines, logs, "both", host="box")
    assert write_alerts(alerts, lines, mode="file")
    assert spark.read.text(lines).count() == 6 and spark.read.text(logs).count() == 3
    assert write_alerts(alerts, lines, None, "both")  # one delivery fails, the other works
    assert not write_alerts(alerts, None, None, "syslog")
    assert not write_alerts(alerts, lines, mode="pigeon")


def test_alert_files_are_closed_by_size(spark, tmp_path):
    texts = [("é" * (i * 37 % 90)) + str(i) for i in range(400)] + ["x" * 5000]
    lines = spark.createDataFrame([(t,) for t in texts], "value STRING").repartition(3)
    order = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go on over batches
    try:
        _append_lines(lines, str(tmp_path / "out"), 1000)
        _append_lines(lines.limit(0), str(tmp_path / "out"), 1000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", order)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "out").rglob("part-*"))
    assert sizes[-1] == 5001 and sizes[-2] <= 1000  # a line beyond the limit is alone
    assert len(sizes) <= 3 + 2 * sum(sizes) / 1000
    found = read_alerts(spark, str(tmp_path / "out"))
    assert found.columns == ["value"] and sorted(r.value for r in found.collect()) == sorted(texts)

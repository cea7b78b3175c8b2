from __future__ import annotations

import math
import threading

import duckdb
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.plans import catalog
from packetloom.plans.catalog import QUERIES
from packetloom.plans.oracle import ORACLE_SQL

TABLES = ("orders", "lineitem", "events", "labels", "embeddings")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(rows, order):
    return sorted((tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    found = canonical(df.collect(), [df.columns.index(c) for c in names])
    wanted = canonical(cursor.fetchall(), [columns.index(c) for c in names])
    assert found == wanted and found


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_scores")))
def test_trained_models_score_every_row(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert len(rows) == 1500 and {r.prediction for r in rows} <= {0, 1}
    assert all(r.score >= 0 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_query_has_sql_or_scores():
    assert {n for n in QUERIES if n not in ORACLE_SQL} == {n for n in QUERIES if n.endswith("_scores")}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_reloaded_models_are_trained_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(len(catalog.RELOADED), timeout=60)

    class Model:
        def fit(self, df):
            meet.wait()
            return self

        def save(self, spark, path):
            return path

        def load(self, spark, path):
            return self

        def transform(self, df):
            return df.withColumn("score", F.lit(0.5))

    monkeypatch.setattr(catalog, "build_model", lambda name, **wanted: Model())
    monkeypatch.setattr(catalog, "labelled_orders", lambda *_: spark.range(3).toDF("o_orderkey"))
    found = sorted(map(tuple, catalog.model_reload(spark, "unused").collect()))
    assert found == sorted((kind, 3, 0) for kind, _, _ in catalog.RELOADED)

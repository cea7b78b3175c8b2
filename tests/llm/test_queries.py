"""Queries against their SQL, and the pipeline against a brute-force run."""

from __future__ import annotations

import re

import duckdb
import pytest
from conftest import SF_DIR
from test_operators import brute_best_fit, brute_components

import corpus_pipeline
from packetloom.llm.line_dedup import ORACLE as LINES
from packetloom.llm.quality_rules import ORACLE as RULES
from packetloom.llm.queries import ORACLE_SQL, QUERIES


def connect():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = connect().execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(cursor.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want and want


def test_pipeline_equals_brute_force(spark):
    duck = connect()
    duck.execute(f"CREATE TABLE kept AS SELECT documents.* FROM documents JOIN ({RULES}) r USING (doc_id) WHERE r.kept")
    duck.execute("DROP VIEW documents")
    duck.execute("CREATE VIEW documents AS SELECT * FROM kept")
    lines = duck.execute(f"SELECT doc_id, text FROM ({LINES}) WHERE n_removed = 0 OR n_removed < n_lines").fetchall()
    single = {i for i, _, _, kept in brute_components(lines, 5, 80) if kept}

    def plain(text):
        return re.findall(r"[^\W_]+", text.lower())

    items = [" ".join(plain(t)) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    clean = [(i, t) for i, t in lines if i in single and not any(item in " ".join(plain(t)) for item in items)]
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in clean}
    assert len({r.sequence_id for r in rows}) == brute_best_fit([r.length for r in rows], 2048)[0]


def test_stages_leave_no_tables_of_their_own(spark):
    import os

    from packetloom.session import scratch_path

    tables, seen = f"{scratch_path(spark)}/tables", []
    before, stages = set(os.listdir(tables)) if os.path.isdir(tables) else set(), corpus_pipeline.STAGES

    def watched(name, stage):
        def begun(spark, docs, sf_dir):
            result = stage(spark, docs, sf_dir)
            seen.append((name, {x.rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before}))
            return result

        return name, begun

    corpus_pipeline.STAGES = [watched(*x) for x in stages]
    try:
        assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    finally:
        corpus_pipeline.STAGES = stages
    seen = dict(seen)
    assert "rule-rows" in seen["quality_rules"] and "rule-rows" not in seen["line_dedup"]
    assert "line-windows" in seen["line_dedup"] and not {"line-windows", "quality_rules"} & seen["near_dedup"]
    assert "signatures" in seen["near_dedup"] and not {"signatures", "sets", "line_dedup"} & seen["decontamination"]
    assert not {"item-windows", "near_dedup"} & seen["packing"] and "decontamination" in seen["packing"]

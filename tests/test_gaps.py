from __future__ import annotations

import random

from packetloom.operators.gaps import last_packets, with_gaps


def expected(rows, start=None):
    last, out = dict(start or {}), {}
    for capture, number, us in sorted(rows):
        before = last.get(capture)
        out[capture, number] = us - before if before else 0
        last[capture] = us
    return out


def test_chunks_agree_with_a_plain_walk(spark):
    draw = random.Random(3)
    rows = [("hot", n, draw.randrange(1, 10**9)) for n in range(500) if n % 3]
    rows += [(f"c{n % 7}", n, draw.randrange(1, 10**9)) for n in range(60)]
    df = spark.createDataFrame(rows, "capture_id STRING, packet_no LONG, ts_us LONG")
    for size in (1, 7, 1000):
        found = {(r.capture_id, r.packet_no): r.gap_us for r in with_gaps(df, chunk_packets=size).collect()}
        assert found == expected(rows)


def test_zero_time_and_negative_gaps(spark):
    rows = [("a", 0, 0), ("a", 1, 50), ("a", 2, 30)]
    df = spark.createDataFrame(rows, "capture_id STRING, packet_no LONG, ts_us LONG")
    assert [r.gap_us for r in with_gaps(df).orderBy("packet_no").collect()] == [0, 0, -20]


def test_captures_continue_across_tables(spark):
    first = [("a", n, 10 * n + 5) for n in range(20)] + [("b", 0, 7)]
    second = [("a", n, 10 * n + 6) for n in range(20, 40)] + [("c", 0, 9)]
    schema = "capture_id STRING, packet_no LONG, ts_us LONG"
    known = last_packets(spark.createDataFrame(first, schema), "capture_id", "packet_no", "ts_us")
    found = with_gaps(spark.createDataFrame(second, schema), chunk_packets=6, initial=known)
    assert {(r.capture_id, r.packet_no): r.gap_us for r in found.collect()} == expected(second, {"a": 195, "b": 7})

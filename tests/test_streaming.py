from __future__ import annotations

import random

import pytest
from packets import ethernet, ip4, tcp
from pyspark.sql import functions as F

from packetloom.models.base import AnomalyModel
from packetloom.schema import FRAME_SCHEMA
from packetloom.streaming.live import (
    frame_stream,
    live_alerts,
    live_gaps,
    live_summary,
    start_live_detection,
    start_live_detection_with_gaps,
    start_with_state,
)

NOW = "2024-06-01 12:30:00"


class SlowPackets(AnomalyModel):
    """Flags packets by port and by the gap before them."""

    model_type = "slow"

    def _fit(self, df, label): ...

    def _transform(self, df):
        flagged = (F.col("inter_arrival_time") > 0.5) | (F.col("tcp_sport") % 5 == 0)
        return df.withColumns({"prediction": flagged.cast("int"), "score": F.lit(0.0), "anomaly_score": F.col("inter_arrival_time")})

    def _save(self, spark, path): ...

    def _load(self, spark, path): ...


@pytest.fixture(scope="module")
def setting(spark):
    draw, rows = random.Random(2), []
    for capture, count in (("hot", 120), ("b", 30), ("c", 9)):
        now = 1_700_000_000_000_000
        for n in range(count):
            now += draw.randrange(1_000_000)
            frame = ethernet(0x0800, ip4(6, tcp(sport=n))) if n % 11 else b"broken"
            rows.append((capture, n, now, 1, bytearray(frame)))
    model = SlowPackets()
    model.features = ["inter_arrival_time", "tcp_sport"]
    return spark.createDataFrame(rows, FRAME_SCHEMA), model


def land(frames, path, condition):
    frames.filter(condition).coalesce(1).write.mode("append").parquet(path)


def same(found, wanted):
    return found.count() == wanted.count() > 0 and found.exceptAll(wanted).count() == 0


@pytest.mark.parametrize("gaps", [False, True])
def test_equals_batch_after_a_restart(spark, setting, tmp_path, gaps):
    frames, model = setting
    feed, out, state = (str(tmp_path / name) for name in ("feed", "out", "state"))
    start = start_live_detection_with_gaps if gaps else start_live_detection
    now = F.lit(NOW).cast("timestamp")
    land(frames, feed, "packet_no < 20")
    land(frames, feed, "packet_no >= 20 and packet_no < 25")
    for condition in (None, "packet_no >= 25"):
        if condition:
            land(frames, feed, condition)
        query = start(frame_stream(spark, feed, 1), model, "m", out, state, "box", available_now=True, now=now)
        query.awaitTermination()
    found = spark.read.parquet(out)
    assert same(found, live_alerts(frames, model, "m", "box", now, gaps=gaps))


def test_replayed_batch_adds_nothing(spark, setting, tmp_path):
    frames, model = setting
    feed, out, state = (str(tmp_path / name) for name in ("feed", "out", "state"))
    now = F.lit(NOW).cast("timestamp")
    land(frames, feed, "packet_no < 40")
    land(frames, feed, "packet_no >= 40")
    run = lambda: start_live_detection_with_gaps(
        frame_stream(spark, feed, 1), model, "m", out, state, "box", available_now=True, now=now
    ).awaitTermination()
    run()
    for name in ("1", ".1.crc"):  # as if the driver was lost before the last commit
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    run()
    assert same(spark.read.parquet(out), live_alerts(frames, model, "m", "box", now, gaps=True))


def test_idle_captures_are_forgotten_and_late_packets_marked(spark, setting, tmp_path):
    frames, _ = setting
    feed, out, state = (str(tmp_path / name) for name in ("feed", "out", "state"))
    # The second landing brings packet 3 late; its captures are idle at once; the third goes on after both.
    landings = [("packet_no < 8 and packet_no <> 3", 3600), ("capture_id <> 'b' and (packet_no = 3 or packet_no = 8)", 0), ("packet_no > 8", 3600)]
    for condition, idle in landings:
        land(frames, feed, condition)
        start_with_state(live_gaps(frame_stream(spark, feed), idle), out, state, available_now=True).awaitTermination()
    times = {(r.capture_id, r.packet_no): r.ts_us for r in frames.collect()}
    found = {(r.capture_id, r.packet_no): (round(r.inter_arrival_time * 1e6), r.late) for r in spark.read.parquet(out).collect()}
    assert found["hot", 3] == found["c", 3] == (0, True) and sum(late for _, late in found.values()) == 2
    assert found["hot", 4] == (times["hot", 4] - times["hot", 2], False) and found["hot", 8] == (times["hot", 8] - times["hot", 7], False)
    assert found["hot", 9] == (0, False)  # forgotten
    assert found["b", 9] == (times["b", 9] - times["b", 7], False)  # not touched by the second landing
    assert found["b", 10] == (times["b", 10] - times["b", 9], False) and found["b", 0] == (0, False)


def test_live_summary(spark, setting, tmp_path):
    frames, _ = setting
    feed = str(tmp_path / "feed")
    land(frames, feed, "true")
    query = live_summary(frame_stream(spark, feed)).writeStream.format("memory").queryName("summaries")
    query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("summaries").collect()
    assert len(rows) == 159 and {r.protocol for r in rows} == {"tcp", "Ethernet"}


def test_a_capture_is_never_held_whole(tmp_path):
    """Blocks of a large capture leave as they came, and none is held while the next one is read."""
    import gc
    import weakref

    import pandas as pd

    from packetloom.streaming.gap_state import GapState

    order = random.Random(5).sample(range(600), 600)
    alive, most = [], []

    def blocks():
        for at in range(0, 600, 50):
            numbers = order[at : at + 50]
            block = pd.DataFrame({"packet_no": numbers, "ts_us": [7 + n * n for n in numbers], "wide": [f"{n}" for n in numbers]})
            alive.append(weakref.ref(block))
            yield block
            del block
            gc.collect()
            most.append(sum(one() is not None for one in alive))

    class Last:
        kept = (3, 20, 0, 10**15)
        exists = staticmethod(lambda: True)
        get = staticmethod(lambda: Last.kept)
        update = staticmethod(lambda kept: setattr(Last, "kept", kept))

    class Handle:
        getValueState = staticmethod(lambda name, schema: Last)
        deleteTimer = registerTimer = staticmethod(lambda at: None)

    class Now:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 1)

    state = GapState(3600)
    state.init(Handle)
    found = list(state.handleInputRows(("c",), blocks(), Now))
    assert max(most) <= 1 and [len(block) for block in found] == [50] * 12
    rows = pd.concat(found, ignore_index=True)
    assert rows["packet_no"].tolist() == order and rows["wide"].tolist() == [str(n) for n in order]
    wanted = {n: 0 if n <= 3 else 23 - 20 if n == 4 else 2 * n - 1 for n in order}
    assert rows["gap_us"].tolist() == [wanted[n] for n in order] and rows["late"].tolist() == [n <= 3 for n in order]
    assert Last.kept[:3] == (599, 7 + 599 * 599, 4)

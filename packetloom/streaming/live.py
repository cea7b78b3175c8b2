"""Live detection over a growing table of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from packetloom.functions.headers import decode_frames, summarize_packets
from packetloom.models.base import AnomalyModel
from packetloom.operators.alerts import project_alerts, render_alerts
from packetloom.operators.clean import clean_features
from packetloom.plans.detect import score_table
from packetloom.plans.extract import extract_features
from packetloom.schema import FEATURE_COLUMNS, FRAME_SCHEMA
from packetloom.streaming.gap_state import IDLE_SECONDS, STATE_STORE, STORE_SETTING, stateful_gaps

KEYS = ("capture_id", "packet_no")


def frame_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The unbounded feed: frames as they land in a folder of Parquet files."""
    reader = spark.readStream.schema(FRAME_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def live_summary(frames: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """One summary row per packet, without any model."""
    return summarize_packets(frames, names)


def live_alerts(frames: DataFrame, model: AnomalyModel, model_name: str, host: str, now: Column | None = None, initial: DataFrame | None = None, gaps: bool = False) -> DataFrame:
    """Frames to alert text, keyed by capture and packet number.

    Without ``gaps`` every packet stands alone (gap 0.0), which needs no state.
    """
    features = extract_features(frames, gaps=gaps, keep=KEYS, initial=initial)
    alerts = project_alerts(score_table(model, features), model_name, model.model_type, keep=KEYS)
    return render_alerts(alerts, host, now, keep=KEYS)


def _writer(stream: DataFrame, checkpoint: str, available_now: bool) -> DataStreamWriter:
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def start_live_detection(
    frames: DataFrame,
    model: AnomalyModel,
    model_name: str,
    alert_path: str,
    checkpoint: str,
    host: str = "localhost",
    available_now: bool = False,
    now: Column | None = None,
) -> StreamingQuery:
    """Stateless scoring into a file sink, which delivers each alert exactly once."""
    alerts = live_alerts(frames, model, model_name, host, now)
    return _writer(alerts, checkpoint, available_now).format("parquet").outputMode("append").start(alert_path)


def live_gaps(frames: DataFrame, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Clean packet features of a stream with real inter-arrival times, and ``late`` for packets that came
    after later ones of their capture."""
    decoded = decode_frames(frames)
    clean = clean_features(decoded.select(*KEYS, "ts_us", *FEATURE_COLUMNS), FEATURE_COLUMNS)
    gaps = stateful_gaps(clean, idle_seconds)
    return gaps.withColumn("inter_arrival_time", F.col("gap_us") / F.lit(1e6)).drop("gap_us")


def start_with_state(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts a query with keyed state into a folder of Parquet files, which delivers each row exactly once."""
    # Timers of processing time would ask for empty batches for ever; they fire with the next packets instead.
    settings = {STORE_SETTING: STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in settings}
    try:  # a query keeps the settings of its start
        for name, value in settings.items():
            conf.set(name, value)
        return _writer(stream, checkpoint, available_now).format("parquet").outputMode("append").start(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def start_live_detection_with_gaps(
    frames: DataFrame,
    model: AnomalyModel,
    model_name: str,
    alert_path: str,
    checkpoint: str,
    host: str = "localhost",
    available_now: bool = False,
    now: Column | None = None,
    idle_seconds: float = IDLE_SECONDS,
) -> StreamingQuery:
    """Scoring with real inter-arrival times across micro-batches.

    The last packet of every live capture is keyed state in Spark's state store; a capture that stays idle is
    forgotten, and packets that come late are scored with gap 0 (see :class:`~packetloom.streaming.gap_state.GapState`).
    """
    features = live_gaps(frames, idle_seconds).drop("ts_us", "late")
    alerts = project_alerts(score_table(model, features), model_name, model.model_type, keep=KEYS)
    return start_with_state(render_alerts(alerts, host, now, keep=KEYS), alert_path, checkpoint, available_now)

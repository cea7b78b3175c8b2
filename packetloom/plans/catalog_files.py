"""Catalog queries that go through files: scans, sinks, whole jobs and live feeds."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.models.base import AnomalyModel
from packetloom.operators.alerts import project_alerts
from packetloom.operators.quantiles import exact_percentile
from packetloom.operators.scaling import SCALER_SCHEMA, Scaler, fit_scaler
from packetloom.plans.detect import detect
from packetloom.plans.extract import land_captures
from packetloom.plans.prepare import prepare_dataset
from packetloom.plans.tables import (
    LINE_FEATURES,
    distance,
    hex_field,
    labelled_lines,
    labelled_orders,
    line_packets,
    micros,
    table,
)
from packetloom.session import scratch_path
from packetloom.sources.captures import read_captures
from packetloom.sources.files import create_binary
from packetloom.sources.paths import make_directory
from packetloom.sources.sinks import read_alerts, write_alerts, write_table
from packetloom.sources.tabular import load_dataset
from packetloom.streaming.live import (
    frame_stream,
    live_summary,
    start_live_detection,
    start_live_detection_with_gaps,
)

ALERT_TIME = "2024-06-01 12:30:00"
ALERT_HOST = "sensor-1"
ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def folder_for(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark)}/catalog/{name}-{uuid.uuid4().hex}"


def alert_time() -> Column:
    """A fixed instant in place of the current time."""
    return F.lit(f"{ALERT_TIME} UTC").cast("timestamp")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a CSV table and read back with declared types."""
    path = write_table(labelled_orders(spark, sf_dir), folder_for(spark, "orders") + ".csv")
    return load_dataset(spark, path, ORDER_SCHEMA)


def csv_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of files with two different headers, united by column name."""
    orders, path = labelled_orders(spark, sf_dir), folder_for(spark, "folder")
    for columns in (["o_orderkey", "o_custkey", "label"], ["o_totalprice", "label", "o_orderkey"]):
        orders.select(*columns).write.mode("append").option("header", True).csv(path)
    return load_dataset(spark, path, ORDER_SCHEMA)


def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping sources combined, balanced and split; the part of every row kept."""
    orders = labelled_orders(spark, sf_dir).select("o_orderkey", "label")
    sources = [write_table(orders, folder_for(spark, f"source{i}") + ".csv") for i in range(2)]
    written = prepare_dataset(
        spark, folder_for(spark, "set") + ".parquet", sources, balance=True, split=True,
        keys=["o_orderkey"], file_format="parquet", schema=ORDER_SCHEMA,
    )
    parts = [spark.read.parquet(written[name]).withColumn("part", F.lit(name)) for name in ("train", "test")]
    return parts[0].unionByName(parts[1])


class DistanceModel(AnomalyModel):
    """A model of one's own: mean squared z-score against a percentile of the training rows."""

    model_type = "distance"
    supervised = False
    scaler: Scaler
    threshold: float

    def _fit(self, df: DataFrame, label: str | None) -> None:
        self.scaler = fit_scaler(df, self.features)
        self.training_rows = self.scaler.rows
        self.threshold = exact_percentile(df.select(distance(self.scaler).alias("score")), "score", 0.95)

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("score", distance(self.scaler)).withColumn("anomaly_score", F.col("score"))
        return scored.withColumn("prediction", (F.col("score") > F.lit(self.threshold)).cast("int"))

    def describe(self) -> dict[str, float]:
        return {"threshold": self.threshold}

    def _save(self, spark: SparkSession, path: str) -> None:
        self.scaler.to_frame(spark).coalesce(1).write.parquet(f"{path}/scaler")

    def _load(self, spark: SparkSession, path: str) -> None:
        self.scaler = Scaler.from_frame(spark.read.schema(SCALER_SCHEMA).parquet(f"{path}/scaler"))
        self.threshold = self.metadata["threshold"]


def batch_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection job: fit, score, write the table, forward the alerts."""
    lines = labelled_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *LINE_FEATURES, "label")
    model = DistanceModel().fit(lines, features=LINE_FEATURES)
    stored, _ = detect(
        spark, model, lines, "distance_v1", folder_for(spark, "scored") + ".parquet",
        alert_path=folder_for(spark, "alerts"), now=alert_time(), file_format="parquet",
    )
    return stored


def alert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts delivered both ways, read back from the two places."""
    alerts = project_alerts(line_packets(spark, sf_dir), "distance_v1", "distance")
    lines, logs = folder_for(spark, "lines"), folder_for(spark, "logs")
    write_alerts(alerts, lines, logs, "both", host=ALERT_HOST, now=alert_time())
    return read_alerts(spark, lines).withColumn("sink", F.lit("file")).unionByName(
        read_alerts(spark, logs).withColumn("sink", F.lit("syslog"))
    )


class GapModel(AnomalyModel):
    """Flags UDP packets by their port and packets after a long pause."""

    model_type = "gap"
    supervised = False

    def _transform(self, df: DataFrame) -> DataFrame:
        late = F.col("inter_arrival_time") > 20_000_000
        flagged = late | (F.col("udp_dport") < 100)
        return df.withColumns({"prediction": flagged.cast("int"), "score": F.col("payload_size") * 1.0, "anomaly_score": F.col("payload_size") * 1.0})


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UDP frame per order: the customer picks capture and port, the date the time."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    payload = (customer % 40).cast("int")
    udp = F.concat(
        hex_field(1024 + key % 60000, 4), hex_field(customer % 1000, 4), hex_field(8 + payload, 4), F.lit("0000")
    )
    ip = F.concat(
        F.lit("4500"), hex_field(28 + payload, 4), hex_field(key % 65536, 4), F.lit("00004011"), F.lit("0000"),
        F.lit("0A0000"), hex_field(customer % 256, 2), F.lit("0A0001"), hex_field(key % 256, 2),
    )
    ether = F.lit("AABBCCDDEEFF1122334455660800")
    text = F.concat(ether, ip, udp, F.repeat(F.lit("00"), payload))
    return table(spark, sf_dir, "orders").select(
        (customer % 8).cast("string").alias("capture_id"),
        key.alias("packet_no"),
        micros("o_orderdate").alias("ts_us"),
        F.lit(1).alias("linktype"),
        F.unhex(text).alias("frame"),
    )


# Packets that one capture file is cut at; a file's packets are sorted in one task.
LOT_PACKETS = 100_000


def _block(order: str, kind: int, body: bytes) -> bytes:
    """A pcapng block: its length stands at both ends."""
    body += bytes(-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def _section(order: str) -> bytes:
    """The beginning of a pcapng section with one Ethernet interface."""
    return _block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(order, 1, struct.pack(order + "HHI", 1, 0, 65535))


def write_captures(frames: DataFrame, folder: str, prefix: str) -> None:
    """Capture files of at most ``LOT_PACKETS`` keys each, written by the tasks that hold their packets.

    Odd captures are pcapng files of two sections, the first of little and the second of big byte order.
    """
    make_directory(frames.sparkSession, folder)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capture, lot = key
        ng = int(capture) % 2 == 1
        path = f"{folder}/{prefix}{capture}-{lot}.pcap{'ng' * ng}"
        rows = rows.sort_values(["ts_us", "packet_no"])
        with create_binary(path) as out:
            out.write(_section("<") if ng else struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for number, row in enumerate(rows.itertuples()):
                size, order = len(row.frame), "<" if 2 * number < len(rows) else ">"
                if not ng:
                    out.write(struct.pack("<IIII", row.ts_us // 1_000_000, row.ts_us % 1_000_000, size, size) + row.frame)
                    continue
                if order == ">" and 2 * (number - 1) < len(rows):
                    out.write(_section(order))
                out.write(_block(order, 6, struct.pack(order + "IIIII", 0, row.ts_us >> 32, row.ts_us & 0xFFFFFFFF, size, size) + row.frame))
        return pd.DataFrame({"path": [path]})

    lot = F.expr(f"packet_no div {LOT_PACKETS}").alias("lot")
    frames.groupBy("capture_id", lot).applyInPandas(write, "path STRING").write.format("noop").mode("overwrite").save()


def _packets_of(frames: DataFrame) -> DataFrame:
    return frames.select(
        F.element_at(F.split("capture_id", "/"), -1).alias("capture"), "packet_no", "ts_us", F.length("frame").alias("length")
    )


def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written in tasks and read back in byte ranges."""
    folder = folder_for(spark, "captures")
    write_captures(order_frames(spark, sf_dir), folder, "c")
    return _packets_of(read_captures(spark, folder, split_bytes=1 << 16, strict=True))


def landed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that come in two lots, landed after each and once more without anything new."""
    folder, target, state = (folder_for(spark, name) for name in ("captures", "landed", "state"))
    for prefix, arrived in zip("ab", _arrivals(spark, sf_dir)):
        write_captures(arrived, folder, prefix)
        land_captures(spark, folder, target, state)
    return _packets_of(land_captures(spark, folder, target, state))


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All packets of the feed in two landings, in the order of their arrival."""
    frames = order_frames(spark, sf_dir)
    middle = exact_percentile(frames, "packet_no", 0.5)
    return [frames.filter(F.col("packet_no") <= middle), frames.filter(F.col("packet_no") > middle)]


def _live(spark: SparkSession, sf_dir: str, start) -> DataFrame:
    """Runs a live query over the first landing, and restarts it when the second has come."""
    model = GapModel()
    model.features = ["inter_arrival_time", "udp_dport", "payload_size"]
    landing, out, state = (folder_for(spark, name) for name in ("landing", "live", "state"))
    for arrived in _arrivals(spark, sf_dir):
        arrived.write.mode("append").parquet(landing)
        query = start(
            frame_stream(spark, landing), model, "gap_v1", out, state,
            host=ALERT_HOST, available_now=True, now=alert_time(),
        )
        query.awaitTermination()
    return spark.read.parquet(out).select("capture_id", "packet_no", "json")


def live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet-by-packet detection on a live feed."""
    return _live(spark, sf_dir, start_live_detection)


def live_alerts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live detection with inter-arrival times that continue across micro-batches."""
    return _live(spark, sf_dir, start_live_detection_with_gaps)


def live_packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live packet summaries, without a model."""
    landing = folder_for(spark, "landing")
    order_frames(spark, sf_dir).write.parquet(landing)
    summaries = live_summary(frame_stream(spark, landing))
    out = folder_for(spark, "summaries")
    writer = summaries.writeStream.option("checkpointLocation", folder_for(spark, "state"))
    writer.format("parquet").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("capture_id", "packet_no", "src", "dst", "protocol", "length")


FILE_QUERIES = {
    "csv_scan": csv_scan,
    "csv_directory": csv_directory,
    "dataset_build": dataset_build,
    "capture_scan": capture_scan,
    "landed_captures": landed_captures,
    "batch_detection": batch_detection,
    "alert_files": alert_files,
    "live_alerts": live_alerts,
    "live_alerts_with_gaps": live_alerts_with_gaps,
    "live_packet_summary": live_packet_summary,
}

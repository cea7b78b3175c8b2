"""From frames or files to clean feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.headers import decode_frames
from packetloom.operators.clean import ADDRESS_COLUMNS, attach_label, clean_features
from packetloom.operators.gaps import CHUNK_PACKETS, with_gaps
from packetloom.schema import FEATURE_COLUMNS, FRAME_SCHEMA
from packetloom.session import materialize
from packetloom.sources.captures import capture_index, indexed_frames, read_captures
from packetloom.sources.paths import path_exists
from packetloom.sources.tabular import file_suffix, load_numeric

CAPTURE_SUFFIXES = (".pcap", ".pcapng", ".cap")


def decode_with_gaps(
    frames: DataFrame, chunk_packets: int = CHUNK_PACKETS, initial: DataFrame | None = None
) -> DataFrame:
    """Features with inter-arrival times.

    A ``previous_us`` column (from the capture reader) is used as it is.  Otherwise the
    packets are decoded first, so that the window moves feature rows and not whole frames.
    """
    seconds = F.lit(1e6)
    if "previous_us" in frames.columns:
        before = F.col("previous_us")
        gap = F.when(before != 0, (F.col("ts_us") - before) / seconds).otherwise(F.lit(0.0))
        return decode_frames(frames, gap).drop("previous_us")
    decoded = with_gaps(decode_frames(frames), chunk_packets=chunk_packets, initial=initial)
    return decoded.withColumn("inter_arrival_time", F.col("gap_us") / seconds).drop("gap_us")


def extract_features(
    frames: DataFrame,
    label: int | None = None,
    gaps: bool = True,
    keep: tuple[str, ...] = (),
    initial: DataFrame | None = None,
) -> DataFrame:
    """The clean 30-column feature table of a ``frames`` table, with a label when given.

    ``gaps=False`` is the packet-by-packet form, where no previous packet is known.
    """
    decoded = decode_with_gaps(frames, initial=initial) if gaps else decode_frames(frames)
    clean = clean_features(decoded.select(*keep, *FEATURE_COLUMNS), FEATURE_COLUMNS)
    return attach_label(clean, label)


def load_input(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Features from a capture or a CSV table, chosen by suffix; a folder holds CSV tables.

    ValueError for another suffix, or for values that are no numbers.
    """
    suffix = file_suffix(path)
    if suffix in CAPTURE_SUFFIXES:
        return extract_features(read_captures(spark, path, previous=True))
    if suffix not in (".csv", ""):
        raise ValueError(f"unsupported input format {suffix!r}; use a capture or a CSV file")
    return load_numeric(spark, [path], schema, ADDRESS_COLUMNS)


def land_captures(spark: SparkSession, path: str, target: str, state: str) -> DataFrame:
    """Decode-ready frames of the captures under ``path`` that have not landed yet, added to ``target``.

    New captures are found by a stream over the folder's listing, whose checkpoint at ``state``
    remembers what has landed; each run handles all captures that have come since the last.  A run
    that was cut short writes its folder again under the same number, so no packet lands twice.
    Returns everything landed so far.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    listing = (
        spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("pathGlobFilter", "*.{pcap,pcapng,cap}").load(path).select("path", "length")
    )

    def land(files: DataFrame, number: int) -> None:
        index = capture_index(materialize(files, "arrived"))
        indexed_frames(index).select(*FRAME_SCHEMA.names).write.mode("overwrite").parquet(f"{target}/landing={number}")

    query = listing.writeStream.foreachBatch(land).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(FRAME_SCHEMA).parquet(target).select(*FRAME_SCHEMA.names)

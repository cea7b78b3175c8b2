"""Inter-arrival times without giving a whole capture to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_PACKETS = 1_000_000


def last_packets(df: DataFrame, capture: str, order: str, ts_us: str) -> DataFrame:
    """``(capture, last_no, last_us)``: the last packet of every capture."""
    return df.groupBy(capture).agg(F.max(order).alias("last_no"), F.max_by(ts_us, order).alias("last_us"))


def _chunk(order: str, chunk_packets: int) -> Column:
    return F.col(order) - F.pmod(order, F.lit(chunk_packets))


def _carried(
    df: DataFrame, capture: str, order: str, ts_us: str, chunk_packets: int, initial: DataFrame | None
) -> DataFrame:
    """``(capture, _chunk, _carry)``: the time of the last packet before each chunk.

    One row per chunk, so the window over a capture sees rows / ``chunk_packets`` rows.
    """
    tails = df.groupBy(capture, _chunk(order, chunk_packets).alias("_chunk")).agg(
        F.max_by(ts_us, order).alias("_tail")
    )
    before = Window.partitionBy(capture).orderBy("_chunk")
    carried = tails.select(capture, "_chunk", F.lag("_tail").over(before).alias("_carry"))
    if initial is None:
        return carried
    known = initial.select(capture, "last_us")
    return carried.join(known, capture, "left").select(
        capture, "_chunk", F.coalesce("_carry", "last_us").alias("_carry")
    )


def with_gaps(
    df: DataFrame,
    capture: str = "capture_id",
    order: str = "packet_no",
    ts_us: str = "ts_us",
    chunk_packets: int = CHUNK_PACKETS,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Adds ``gap_us``: microseconds since the previous packet of the same capture.

    The previous packet is the one before in ``order`` (an integer, unique per capture).
    The first packet has gap 0, as does one whose predecessor has time 0; negative gaps
    are kept.  Chunks hold at most ``chunk_packets`` packets; ``lag`` runs inside a chunk
    and the first packet of a chunk takes the carried time of the chunk before, joined on
    the key the window is already partitioned by.  ``initial`` (``last_packets`` of what came
    earlier) continues captures across tables.
    """
    carried = _carried(df, capture, order, ts_us, chunk_packets, initial)
    chunked = df.withColumn("_chunk", _chunk(order, chunk_packets))
    inside = Window.partitionBy(capture, "_chunk").orderBy(order)
    previous = F.coalesce(F.lag(ts_us).over(inside), F.col("_carry"))
    joined = chunked.join(carried, [capture, "_chunk"], "left")
    gap = F.when(previous != 0, F.col(ts_us) - previous).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("gap_us", gap).drop("_chunk", "_carry")

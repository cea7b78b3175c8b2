"""Packet captures (pcap, pcapng) as a distributed ``frames`` table.

A capture is a chain of records without marks to split at.  Each byte range looks for the
first plausible chain of records in its range and walks to its end; the ranges are right
exactly when every walk ends where the next one began, which is checked, and ranges that
began wrong are walked again from the proven position.  So one huge capture is read by many
tasks, packet numbers are exact, and each task streams its range with bounded memory.

Blocks of pcapng name their length at both ends, which is what ranges look for.  What such a block means depends
on the section and the interfaces announced before it; every range collects those it holds, and then
takes over what the ranges before it announced since their last section began.

What cannot be read is counted: ``capture_report`` says for each capture how many packets were read, how
many bytes at its end were not, and why.
"""

from __future__ import annotations

import io
import logging
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.schema import FRAME_SCHEMA
from packetloom.session import materialize
from packetloom.sources.files import list_files, open_binary
from packetloom.sources.paths import path_exists

SPLIT_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000
# Bytes of a task where ranges are smaller, and bytes that a stream reads at once.
TASK_BYTES, BUFFER_BYTES = 16 << 20, 4 << 20
CHAIN_RECORDS = 24
MAX_TASKS = 100_000

# Fixed values of the two capture formats.
PCAP_MAGICS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
PCAP_HEADER, RECORD_HEADER = 24, 16
NG_SECTION, NG_INTERFACE, NG_OLD_PACKET, NG_SIMPLE_PACKET, NG_PACKET = 0x0A0D0D0A, 1, 2, 3, 6
NG_BYTE_ORDER = 0x1A2B3C4D
NG_OPTION_RESOLUTION, NG_OPTION_OFFSET = 9, 14
NG_KINDS = (NG_SECTION, NG_INTERFACE, NG_OLD_PACKET, NG_SIMPLE_PACKET, 4, 5, NG_PACKET, 9, 10, 0xBAD, 0x40000BAD)
LARGEST_RECORD = 1 << 20
PLAUSIBLE_SECONDS = 10 * 366 * 86_400

INDEX_SCHEMA = (
    "path STRING, length LONG, split LONG, start LONG, stop LONG, first LONG, next LONG, "
    "packets LONG, last_us LONG, status STRING, unread_bytes LONG, byte_order STRING, "
    "heads ARRAY<STRUCT<at: LONG, byte_order: STRING, kind: LONG, body: BINARY>>"
)
_OWN = ["first", "next", "packets", "last_us", "status", "unread_bytes", "byte_order", "heads"]
_log = logging.getLogger(__name__)


@dataclass
class _Format:
    """What a capture's own header says."""

    order: str = "<"
    ticks: int = 1_000_000
    linktype: int = 1
    next_generation: bool = False


@dataclass
class _Interface:
    linktype: int
    ticks: int = 1_000_000
    offset_seconds: int = 0


@dataclass
class _Section:
    order: str = "<"
    interfaces: list[_Interface] = field(default_factory=list)


def _open(path: str, wanted: int = BUFFER_BYTES) -> io.BufferedReader:
    """A stream that reads about as many bytes at once as are ``wanted`` of the file."""
    return io.BufferedReader(open_binary(path), min(max(int(wanted), 1 << 13), BUFFER_BYTES))


def _read_format(stream: io.BufferedReader) -> _Format | None:
    """The format by its magic number; None for anything that is no capture."""
    stream.seek(0)
    head = stream.read(PCAP_HEADER)
    if len(head) >= 4 and struct.unpack("<I", head[:4])[0] == NG_SECTION:
        return _Format(next_generation=True)
    if len(head) < PCAP_HEADER:
        return None
    for order in "<>":
        magic, *_, network = struct.unpack(order + "IHHiIII", head)
        if magic in PCAP_MAGICS:
            return _Format(order, PCAP_MAGICS[magic], network & 0x0FFFFFFF)
    return None


Packet = tuple[int, int, int, bytes | None]


def _classic_packets(
    stream: io.BufferedReader, form: _Format, first: int, stop: int, length: int, data: bool
) -> Iterator[Packet]:
    """``(next offset, time, link type, bytes)`` of the records that begin before ``stop``."""
    header = struct.Struct(form.order + "IIII")
    at = first
    stream.seek(at)
    while at < stop and at + RECORD_HEADER <= length:
        seconds, fraction, captured, _ = header.unpack(stream.read(RECORD_HEADER))
        following = at + RECORD_HEADER + captured
        if following > length:
            return  # cut off in the middle of the last record
        content = stream.read(captured) if data else stream.seek(captured, 1) and None
        at = following
        yield at, seconds * 1_000_000 + fraction * 1_000_000 // form.ticks, form.linktype, content


def _interface_of(order: str, body: bytes) -> _Interface:
    found = _Interface(struct.unpack_from(order + "H", body)[0])
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        value = body[at + 4 : at + 4 + size]
        if code == NG_OPTION_RESOLUTION and value:
            found.ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == NG_OPTION_OFFSET and size == 8:
            found.offset_seconds = struct.unpack(order + "q", value)[0]
        at += 4 + (size + 3) // 4 * 4
    return found


def _blocks(
    stream: io.BufferedReader, length: int, first: int = 0, stop: int | None = None, order: str = "<", skip: bool = False
) -> Iterator[tuple[int, int, str, int, bytes]]:
    """``(offset, next offset, byte order, type, body)`` of whole pcapng blocks that begin from ``first`` to
    ``stop``.  With ``skip`` only the start of a body is read, except of sections and interfaces."""
    at = first
    stream.seek(at)
    while at < (length if stop is None else stop) and at + 12 <= length:
        head = stream.read(12)
        kind = struct.unpack(order + "I", head[:4])[0]
        if kind == NG_SECTION:
            order = "<" if struct.unpack("<I", head[8:])[0] == NG_BYTE_ORDER else ">"
        size = struct.unpack(order + "I", head[4:8])[0]
        if size < 12 or size % 4 or at + size > length:
            return
        if skip and kind not in (NG_SECTION, NG_INTERFACE) and size > 64:
            body = head[8:] + stream.read(20)
            stream.seek(at + size)
        else:
            body = (head[8:] + stream.read(size - 12))[:-4]
        begin, at = at, at + size
        yield begin, at, order, kind, body


def _block_packet(section: _Section, kind: int, body: bytes) -> tuple[int, int, bytes] | None:
    """Time, link type and bytes of a packet block; None for other blocks."""
    order, interfaces = section.order, section.interfaces
    if kind == NG_PACKET:
        number, high, low, captured, _ = struct.unpack_from(order + "IIIII", body)
    elif kind == NG_OLD_PACKET:
        number, _, high, low, captured, _ = struct.unpack_from(order + "HHIIII", body)
    elif kind == NG_SIMPLE_PACKET and interfaces:
        original = struct.unpack_from(order + "I", body)[0]
        return 0, interfaces[0].linktype, body[4 : 4 + original]
    else:
        return None
    if number >= len(interfaces):
        return None
    source = interfaces[number]
    ticks = (high << 32 | low) * 1_000_000 // source.ticks
    return ticks + source.offset_seconds * 1_000_000, source.linktype, body[20 : 20 + captured]


def _ng_packets(
    stream: io.BufferedReader, first: int, stop: int, length: int, state: list | None, data: bool
) -> Iterator[Packet]:
    """Packets of the blocks of a range; ``state`` holds the section and interface blocks it takes over."""
    section = _Section()
    for head in state if state is not None else ():
        section = _announced(section, head["byte_order"], head["kind"], bytes(head["body"]))
    for _, following, order, kind, body in _blocks(stream, length, first, stop, section.order, not data):
        section = _announced(section, order, kind, body)
        if (packet := _block_packet(section, kind, body)) is not None:
            time_us, linktype, content = packet
            yield following, time_us, linktype, content


def _announced(section: _Section, order: str, kind: int, body: bytes) -> _Section:
    if kind == NG_SECTION:
        return _Section(order)
    if kind == NG_INTERFACE:
        section.interfaces.append(_interface_of(order, body))
    return section


def _packets(stream, form: _Format, first: int, stop: int, length: int, data: bool, state: list | None = None) -> Iterator[Packet]:
    if form.next_generation:
        return _ng_packets(stream, first, stop, length, state, data)
    return _classic_packets(stream, form, first, stop, length, data)


def _find_block(stream: io.BufferedReader, start: int, stop: int, length: int) -> tuple[int, str] | None:
    """The first offset in the range that begins a plausible chain of blocks, and their byte order.

    Blocks begin at multiples of four; a candidate has a known type and a length that fits."""
    start += -start % 4
    while start < stop:
        stream.seek(start)
        raw = stream.read(min(4 * LARGEST_RECORD, stop - start + 4))
        words = {order: np.frombuffer(raw[: len(raw) // 4 * 4], order + "u4").astype(np.int64) for order in "<>"}
        spots = len(words["<"]) - 1
        if spots <= 0:
            break
        at = start + 4 * np.arange(spots)
        for spot in np.flatnonzero(
            np.logical_or.reduce([
                np.isin(w[:spots], NG_KINDS) & (w[1:] >= 12) & (w[1:] % 4 == 0) & (at + w[1:] <= length) for w in words.values()
            ])
        ):
            for order in "<>":
                if _blocks_hold(stream, order, int(at[spot]), length):
                    return int(at[spot]), order
        start += 4 * spots
    return None


def _blocks_hold(stream: io.BufferedReader, order: str, at: int, length: int) -> bool:
    for number in range(CHAIN_RECORDS):
        if at + 12 > length:
            return at == length and number > 0
        stream.seek(at)
        head = stream.read(12)
        kind = struct.unpack(order + "I", head[:4])[0]
        if kind == NG_SECTION:
            order = "<" if struct.unpack("<I", head[8:])[0] == NG_BYTE_ORDER else ">"
        size = struct.unpack(order + "I", head[4:8])[0]
        if size < 12 or size % 4 or at + size > length or number == 0 and kind not in NG_KINDS:
            return False
        stream.seek(at + size - 4)
        if struct.unpack(order + "I", stream.read(4))[0] != size:
            return False
        at += size
    return True


def _find_record(stream: io.BufferedReader, form: _Format, start: int, stop: int, length: int) -> int | None:
    """The first offset in the range that begins a plausible chain of records."""
    stream.seek(PCAP_HEADER)
    about = struct.unpack(form.order + "I", stream.read(4))[0]
    while start < stop:
        stream.seek(start)
        window = min(4 * LARGEST_RECORD, stop - start + RECORD_HEADER - 1)
        block = np.frombuffer(stream.read(window), dtype=np.uint8).astype(np.int64)
        if len(block) < RECORD_HEADER:
            break
        shifts = (0, 8, 16, 24) if form.order == "<" else (24, 16, 8, 0)
        words = sum(block[i : len(block) - 3 + i] << shift for i, shift in enumerate(shifts))
        spots = len(block) - RECORD_HEADER + 1
        seconds, fraction = words[:spots], words[4 : spots + 4]
        captured, original = words[8 : spots + 8], words[12 : spots + 12]
        plausible = (
            (abs(seconds - about) < PLAUSIBLE_SECONDS)
            & (fraction < form.ticks)
            & (captured <= np.minimum(original, LARGEST_RECORD))
            & (original > 0)
        )
        for spot in np.flatnonzero(plausible):
            if _chain_holds(stream, form, start + int(spot), length):
                return start + int(spot)
        start += spots
    return None


def _chain_holds(stream: io.BufferedReader, form: _Format, at: int, length: int) -> bool:
    header = struct.Struct(form.order + "IIII")
    for _ in range(CHAIN_RECORDS):
        if at + RECORD_HEADER > length:
            return at == length
        stream.seek(at)
        _, fraction, captured, original = header.unpack(stream.read(RECORD_HEADER))
        if fraction >= form.ticks or captured > min(original, LARGEST_RECORD):
            return False
        at += RECORD_HEADER + captured
    return True


def _found(first: int | None, following: int | None, **more: object) -> dict:
    return {"first": first, "next": following, "packets": 0, "last_us": None, "status": "ok", "unread_bytes": 0, "byte_order": None, "heads": None} | more


def _walked(stream: io.BufferedReader, form: _Format, first: int, stop: int, length: int, order: str = "<") -> dict:
    """What a range holds whose first record begins at ``first``; packets of pcapng are counted later."""
    found = _found(first, first)
    if form.next_generation:
        heads = []
        for at, found["next"], order, kind, body in _blocks(stream, length, first, stop, order, skip=True):
            if kind in (NG_SECTION, NG_INTERFACE):
                heads.append({"at": at, "byte_order": order, "kind": kind, "body": body})
        found |= {"byte_order": order, "heads": heads}
    else:
        for found["next"], found["last_us"], _, _ in _packets(stream, form, first, stop, length, data=False):
            found["packets"] += 1
    if found["next"] < stop:
        # The next record does not fit into the file: it is cut off, or its length is damaged.
        found |= {"next": length, "status": "broken", "unread_bytes": length - found["next"]}
    return found


def _index_range(row) -> dict:
    """The first record of one byte range as far as the range itself can tell, and what follows it."""
    with _open(row.path, row.stop - row.start) as stream:
        form = _read_format(stream)
        if form is None:
            lost = row.stop - row.start
            return _found(None, row.length if row.start == 0 else None, status="foreign" if row.length else "empty", unread_bytes=lost)
        order = "<"
        if row.start == 0:
            first = 0 if form.next_generation else PCAP_HEADER
        elif form.next_generation:
            first, order = _find_block(stream, row.start, row.stop, row.length) or (None, order)
        else:
            first = _find_record(stream, form, row.start, row.stop, row.length)
        return _found(None, None) if first is None else _walked(stream, form, first, row.stop, row.length, order)


def _framed(rows: pd.DataFrame, found: list[dict]) -> pd.DataFrame:
    columns = pd.DataFrame(found, columns=_OWN)
    numbers = {c: "Int64" for c in _OWN if c not in ("status", "byte_order", "heads")}
    return pd.concat([rows[["path", "length", "split", "start", "stop"]].reset_index(drop=True), columns.astype(numbers)], axis=1)


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _framed(batch, [_index_range(row) for row in batch.itertuples(index=False)])


def _repaired(rows: pd.DataFrame) -> pd.DataFrame:
    """All ranges of one file in order: those that began right stay, the others are walked from where the
    range before ended.  Only wrong ranges are read again."""
    rows = rows.sort_values("split")
    found, due, order = [], None, "<"
    with _open(rows.path.iloc[0]) as stream:
        form = _read_format(stream)
        for row in rows.itertuples(index=False):
            own = {c: getattr(row, c) for c in _OWN}
            own |= {c: None if pd.isna(own[c]) else own[c] for c in _OWN if c != "heads"}
            if due is not None and due >= row.stop:
                own = _found(None, None)
            elif due is not None and own["first"] != due:
                own = _walked(stream, form, int(due), int(row.stop), int(row.length), order)
            due = own["next"] if own["next"] is not None else due
            order = own["byte_order"] or order
            found.append(own)
    return _framed(rows, found)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packets and last time of pcapng ranges, with what they take over (``state``)."""
    for batch in batches:
        packets, last = [], []
        for row in batch.itertuples(index=False):
            number, time_us = 0, None
            with _open(row.path, row.stop - row.first) as stream:
                for _, time_us, _, _ in _ng_packets(stream, int(row.first), int(row.stop), int(row.length), row.state, data=False):
                    number += 1
            packets.append(number)
            last.append(time_us)
        yield batch.assign(packets=packets, last_us=pd.array(last, "Int64"))


def _with_state(index: DataFrame) -> DataFrame:
    """Adds ``state``, the blocks announced since the last section that began before a range, and counts pcapng packets."""
    index = index.withColumn("state", F.lit(None).cast(index.schema["heads"].dataType))
    ranges = index.where("heads is not null")
    if ranges.isEmpty():
        return index.drop("heads", "byte_order")
    heads = ranges.select("path", F.explode("heads").alias("head"))
    begins = heads.where(F.col("head.kind") == NG_SECTION).select("path", F.col("head.at").alias("begin"))
    # One row per range and section before it, of which the last counts; then the blocks from there to the range.
    last = ranges.select("path", "split", "first").join(begins, "path").where("begin < first").groupBy("path", "split").agg(F.max("begin").alias("begin"))
    taken = last.join(ranges.select("path", "split", "first"), ["path", "split"]).join(heads, "path")
    taken = taken.where((F.col("head.at") >= F.col("begin")) & (F.col("head.at") < F.col("first")))
    states = taken.groupBy("path", "split").agg(F.array_sort(F.collect_list("head")).alias("state"))
    told = ranges.drop("state").join(states, ["path", "split"], "left").drop("heads", "byte_order")
    counted = _spread(materialize(told, "sections")).mapInPandas(_counted, told.schema)
    return index.where("heads is null").drop("heads", "byte_order").unionByName(counted)


_ARROW_SCHEMA = pa.schema(
    [
        ("capture_id", pa.string()),
        ("packet_no", pa.int64()),
        ("ts_us", pa.int64()),
        ("linktype", pa.int32()),
        ("frame", pa.binary()),
        ("previous_us", pa.int64()),
    ]
)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW_SCHEMA.types)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)


def _frame_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["path"], row["stop"] - row["first"]) as stream:
                form = _read_format(stream)
                rows, held, number, previous = [], 0, row["base"], row["carry_us"]
                for _, time_us, linktype, content in _packets(
                    stream, form, row["first"], row["stop"], row["length"], data=True, state=row["state"]
                ):
                    rows.append((row["path"], number, time_us, linktype, content, previous))
                    number, previous, held = number + 1, time_us, held + len(content)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _arrow(rows)
                        rows, held = [], 0
                if rows:
                    yield _arrow(rows)


def _spread(ranges: DataFrame, begin: str = "start") -> DataFrame:
    """One byte range per task, or as many small ones as make up ``TASK_BYTES``."""
    facts = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col(begin)).alias("bytes")).first()
    wanted = max(-(-(facts.bytes or 0) // TASK_BYTES), 2 * ranges.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(max(1, min(facts.n, wanted, MAX_TASKS)))


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all captures under ``path``."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return list_files(spark, path, "*.{pcap,pcapng,cap}")


def capture_index(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Proven byte ranges of captures (``path, length``) with their packet counts."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes))
    ranges = files.select("path", "length", F.posexplode(starts).alias("split", "start")).select(
        "path",
        "length",
        F.col("split").cast("long").alias("split"),
        "start",
        F.least(F.col("start") + split_bytes, "length").alias("stop"),
    )
    index = materialize(_spread(ranges).mapInPandas(_index, INDEX_SCHEMA), "captures")
    # A range is right if its first record is where the last record before it ended, or if that record
    # ends behind the range.
    order = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    due = F.last("next", ignorenulls=True).over(order)
    right = due.isNull() | F.when(due >= F.col("stop"), F.col("first").isNull()).otherwise(F.col("first").eqNullSafe(due))
    wrong = index.withColumn("_wrong", ~right & (F.col("status") != "foreign")).where("_wrong").select("path").distinct()
    wrong = materialize(wrong, "wrong-captures")
    if not wrong.isEmpty():
        repaired = index.join(wrong, "path", "left_semi").groupBy("path").applyInPandas(_repaired, INDEX_SCHEMA)
        index = materialize(index.join(wrong, "path", "left_anti").unionByName(repaired), "captures")
    return materialize(_with_state(index), "capture-ranges")


def capture_report(index: DataFrame) -> DataFrame:
    """``path, packets, status, unread_bytes`` of every capture; ``ok`` unless something was not read."""
    worst = F.max(F.when(F.col("status") != "ok", F.col("status")))
    return index.groupBy("path").agg(
        F.sum("packets").alias("packets"), F.coalesce(worst, F.lit("ok")).alias("status"), F.sum("unread_bytes").alias("unread_bytes")
    )


def read_captures(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, previous: bool = False, strict: bool = False
) -> DataFrame:
    """All packets of the captures under ``path`` as a ``frames`` table.

    With ``previous`` a column ``previous_us`` holds the time of the packet before in the
    same capture; the reader knows it, so no window over the packets is needed.  Captures that
    could not be read whole are logged; with ``strict`` they are a ValueError.
    """
    index = capture_index(capture_files(spark, path), split_bytes)
    lost = capture_report(index).where("status not in ('ok', 'empty')")
    summary = lost.groupBy("status").agg(F.count("*").alias("files"), F.sum("unread_bytes").alias("bytes"), F.min("path").alias("one")).collect()
    for row in summary:
        _log.warning("%d %s captures, %d bytes not read, such as %s", row.files, row.status, row.bytes, row.one)
    if strict and summary:
        raise ValueError(f"captures that cannot be read whole, such as {summary[0].one}")
    return indexed_frames(index, previous)


def indexed_frames(index: DataFrame, previous: bool = False) -> DataFrame:
    """The packets of proven ranges."""
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.select(
        "path",
        "length",
        "first",
        "stop",
        "packets",
        "state",
        F.coalesce(F.sum("packets").over(before), F.lit(0)).alias("base"),
        F.last("last_us", ignorenulls=True).over(before).alias("carry_us"),
    ).filter("packets > 0")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FRAME_SCHEMA)
    frames = _spread(placed, "first").mapInArrow(_frame_batches, f"{columns}, previous_us LONG")
    return frames if previous else frames.drop("previous_us")


def bounded_capture(
    frames: DataFrame,
    packets: int | None = None,
    seconds: float | None = None,
    ts_us: str = "ts_us",
    order: tuple[str, ...] = ("ts_us", "capture_id", "packet_no"),
) -> DataFrame:
    """The first ``packets`` packets of a feed, or those of its first ``seconds``, or both."""
    if seconds is not None:
        begin = frames.agg(F.min(ts_us)).first()[0]
        if begin is not None:
            frames = frames.filter(F.col(ts_us) <= F.lit(begin + int(seconds * 1_000_000)))
    if packets:
        frames = frames.orderBy(*order).limit(packets)
    return frames

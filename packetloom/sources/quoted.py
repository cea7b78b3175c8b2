"""CSV files whose quoted fields hold line breaks, read by many tasks.

A byte lies inside a quoted field exactly when an odd number of quotes comes before it (a quote inside a
field is doubled and so counts twice).  One pass counts the quotes of every byte range, a running sum tells how
each range begins, and each range then cuts out the records that start inside it, reading on past its end
until the last one is complete.  Spark's own CSV functions take the records apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.session import materialize
from packetloom.sources.files import open_binary

SPLIT_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
# More ranges than this share tasks; each is read on its own, so a task's memory is that of one range.
MAX_TASKS = 20_000
QUOTE, BREAK = 34, 10
# A quote inside a quoted field is written twice, here and wherever this library writes tables.
CSV_OPTIONS = {"quote": '"', "escape": '"'}


def _pieces(path: str, start: int, stop: int | None = None) -> Iterator[bytes]:
    with open_binary(path) as stream:
        stream.seek(start)
        while (stop is None or start < stop) and (
            piece := stream.read(PIECE_BYTES if stop is None else min(PIECE_BYTES, stop - start))
        ):
            start += len(piece)
            yield piece


def first_record(path: str) -> bytes:
    """The bytes of a file up to its first line break outside quotes."""
    found, inside = [], 0
    for piece in _pieces(path, 0):
        ends, inside = _ends(piece, inside)
        if len(ends):
            return b"".join([*found, piece[: ends[0]]])
        found.append(piece)
    return b"".join(found)


def _ends(data: bytes, inside: int) -> tuple[np.ndarray, int]:
    """Positions of the line breaks that end a record, and whether ``data`` ends inside quotes."""
    values = np.frombuffer(data, np.uint8)
    # Only the last bit matters, so the sums may wrap.
    quotes = np.cumsum(values == QUOTE, dtype=np.uint8) + np.uint8(inside)
    ends = np.flatnonzero((values == BREAK) & (quotes & 1 == 0))
    return ends, int(quotes[-1] & 1) if len(quotes) else inside


def _count_quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [sum(p.count(b'"') for p in _pieces(r.path, r.start, r.stop)) for r in batch.itertuples(index=False)]
        yield batch.assign(quotes=found)


def _range_records(path: str, start: int, stop: int, inside: int) -> pa.Array:
    """The records that start in a byte range, with their line breaks; the first of a file is its header."""
    data = b"".join(_pieces(path, start, stop))
    ends, open_at_stop = _ends(data, inside)
    before = next(_pieces(path, start - 1, start)) if start else b"\n"
    starts_here = before == b"\n" and not inside
    bounds = ends + 1
    if start == 0 or not starts_here:
        # Without a header or a whole record there is nothing of this range's own before the first break.
        first = bounds[:1]
    else:
        first = np.zeros(1, int)
    if not len(first) or first[0] >= len(data):
        return pa.array([], pa.binary())
    tail, size = [], len(data)
    if not len(bounds) or bounds[-1] < size:
        for piece in _pieces(path, stop):
            more, open_at_stop = _ends(piece, open_at_stop)
            tail.append(piece[: more[0] + 1] if len(more) else piece)
            if len(more):
                break
        data = b"".join([data, *tail])
        bounds = np.append(bounds, len(data))
    offsets = np.concatenate([first, bounds[bounds > first[0]]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            records = _range_records(row["path"], row["start"], row["stop"], row["inside"])
            if len(records):
                name = pa.array([row["path"].rsplit("/", 1)[-1]] * len(records), pa.string())
                yield pa.RecordBatch.from_arrays([records, name], ["record", "file"])


def _spread(ranges: DataFrame) -> DataFrame:
    return ranges.repartition(max(1, min(ranges.count(), MAX_TASKS)))


def record_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges of ``files`` (path, length) and whether each begins ``inside`` a quoted field."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    counted = _spread(materialize(ranges, "ranges")).mapInPandas(
        _count_quotes, "path STRING, start LONG, stop LONG, quotes LONG"
    )
    # Narrow rows, one for each range of a file.
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    return materialize(counted.select("path", "start", "stop", inside.cast("int").alias("inside")), "ranges")


def read_quoted(files: DataFrame, header: list[str], source: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Text columns of the records in ``files`` (path, length), which share ``header``.

    Empty lines are left out, missing fields are NULL.  ``source`` names a column for the base name of the file.
    """
    cut = _spread(record_ranges(files, split_bytes)).mapInArrow(_cut, "record BINARY, file STRING")
    text = F.rtrim(F.decode("record", "UTF-8"), F.lit("\r\n"))
    schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in header)
    fields = cut.select(text.alias("record"), "file").filter("record <> ''")
    parsed = fields.select(F.from_csv("record", schema, CSV_OPTIONS).alias("fields"), "file")
    return parsed.select("fields.*", *([F.col("file").alias(source)] if source else []))

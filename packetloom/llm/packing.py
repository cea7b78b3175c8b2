"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Texts are tokenised in tasks; a document longer than a sequence is cut so that all its pieces but the
first are full.  Pieces are numbered per task and length as they are made, so no sort is needed later.
Which piece goes where depends only on how many pieces of each length exist: at most one count per
length reaches the driver, where best-fit decreasing runs over those counts.  A segment tree over
remaining capacities holds the open bins; the tightest bin that fits a length is found in logarithmic
time and all bins and pieces alike are placed at once.  The plan is a few rows per length; every piece
finds its bin from its number among the pieces of its length.
"""

from __future__ import annotations

import re
from array import array
from base64 import b64decode
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.support import materialize, texts_of

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
_LONG_SPACE = re.compile(r"\s{100000}")
_encoders: dict[str, object] = {}


def encoder(name: str):
    """Function from a text to its ids (array of unsigned 32 bit) for a tokenizer file.

    The rank file beside it holds the same vocabulary for a faster encoder.  Its ids are equal for
    Latin text; text with other letters, a special token's string or a run of white space that the fast
    encoder's pattern cannot hold takes the tokenizer file itself.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> array:
            if SPECIAL in text or (not text.isascii() and max(text) > "ɏ") or _LONG_SPACE.search(text):
                return array("I", exact.encode(text, add_special_tokens=False).ids)
            return array("I", fast.encode_ordinary(text))

        _encoders[name] = encode
    return _encoders[name]


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("task", pa.int64()), ("nth", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, with its number ``nth`` among the pieces
    of its length that the task ``task`` made; ``ids`` too on demand."""
    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py())
                ids.append(END_ID)
                head = len(ids) % capacity or capacity
                ends = range(head, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    part = ids[max(0, end - capacity if piece else 0) : end]
                    rows.append((doc_id, piece, end - len(part), len(part), crc32(part.tobytes()), task, made[len(part)], part))
                    made[len(part)] += 1
            columns = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, t.type) for c, t in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
    return texts_of(docs).mapInArrow(run, fields + (", ids array<long>" if with_ids else ""))


class OpenBins:
    """Bins with room, grouped by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def _add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += bins
            at >>= 1

    def put(self, room: int, first: int, bins: int) -> None:
        """``bins`` bins numbered from ``first`` now have ``room``."""
        if room and bins:
            self.groups.setdefault(room, []).append((first, bins))
            self._add(room, bins)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, first, bins) of a group with the smallest room of at least ``least``."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        first, bins = self.groups[room].pop()
        self._add(room, -bins)
        return room, first, bins


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces: runs ``(length, first piece, pieces per bin,
    first bin, offset)``; the pieces of a length are numbered from 0, and runs are in their order.

    One piece at a time, the tightest bin takes it, and a bin that took one is tighter still: so a bin
    takes as many of the length as fit before the next one opens, and equal bins can be treated together.
    """
    open_bins, runs, next_bin = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            room, first, bins = open_bins.take(length) or (capacity, next_bin, left)
            each = room // length
            used = min(bins, -(-left // each))
            if first == next_bin:
                bins, next_bin = used, next_bin + used
            taken = min(left, used * each)
            runs.append((length, placed, each, first, capacity - room))
            full, rest = divmod(taken, each)
            open_bins.put(room, first + used, bins - used)
            open_bins.put(room - each * length, first, full)
            if rest:
                open_bins.put(room - rest * length, first + full, 1)
            placed, left = placed + taken, left - taken
    return runs


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    NULL texts count as empty: one end token.  Texts are tokenised whole, also those of a million spaces or line
    breaks.  Repeated rows are packed as often as they come.  Other
    columns are ignored.  An empty table gives an empty table.
    """
    made = materialize(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    tasks = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    tasks = materialize(tasks, "piece-counts")
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan_bins(counts, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = tasks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = made.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = runs[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = {n: batch.column(n) for n in names}
            columns["sequence_id"] = pa.array(row[:, 3] + nth // row[:, 2])
            columns["offset"] = pa.array(row[:, 4] + nth % row[:, 2] * length)
            yield pa.RecordBatch.from_pydict(columns)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kept = numbered.select(*names, "rank")
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return kept.mapInArrow(run, fields + ", sequence_id long, offset long")

"""Removal of every byte that lies in a passage of SIZE bytes which also starts elsewhere.

Suffix sorting is kept to where it decides something.  In every window of SIZE bytes one place is chosen by
its content alone (the least hash of the runs of ``GRAM`` bytes inside), so equal windows choose the same
place, and windows are compared where they chose the same bytes:

1. *Anchors.*  All windows around a chosen place are compared at once by two hashes: of the chosen bytes, and
   of everything the windows cover.  If all of it occurs again, all of it is repeated; if the chosen bytes
   occur nowhere else, none of it is.  This settles nearly all text.
2. *Pieces.*  The rest is cut into pieces of STEP neighbouring windows.  The bytes that all windows of a piece
   share are its core; pieces with the same core differ by fewer than STEP bytes on either side.  Again equal
   pieces are repeated, and a core that occurs once is not.
3. *Suffix arrays.*  What is left are pieces with the same core and different sides, so the core is one symbol:
   the sides and that symbol are the text of a suffix array, many cores to an array, and windows that start
   adjacent suffixes with a common prefix of STEP symbols are repeated.

A copy adds to a count with partial sums and nothing else, however often it is copied.  A core with more
different sides than MEMBERS (a passage quoted by a third of all documents, between different words) is
decided window by window, by counting equal sides in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.shingles import hashes_from, joined, mix, running_sums
from packetloom.llm.suffix_array import suffix_array
from packetloom.llm.support import join_counted, materialize, text_blocks, texts_of

SIZE = 400
GRAM = 64
# Windows that share one chosen place at most, and windows of one piece.
REACH = SIZE - GRAM + 1
STEP = 16
# Pieces of one core that meet in one suffix array; cores with more are counted window by window.
MEMBERS = 4096
# Pieces that one task sorts, about.
TASK_PIECES = 20_000
# Symbols of one suffix array, about.
SYMBOLS = 1 << 14

_LOW = np.uint64(0xFFFFFFFF)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with the key of their row, ``doc_id`` and a hash of the text."""
    return texts_of(docs).withColumn("text_key", F.xxhash64("text"))


def _sliding_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes, the place of the least (the first of equal ones)."""
    least = (keys & ~_LOW) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        shift = width - span
        least = np.minimum(least[:-shift], least[shift:])
    return (least & _LOW).astype(np.int64)


def _sides(core: np.ndarray, step: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes there are on both sides of the core of ``step`` windows, ``step - 1`` at most.

    ``core`` is where the last window of each piece starts, which is where the bytes begin that all share.
    """
    left = np.minimum(step - 1, core - starts)
    right = np.minimum(step - 1, ends - (core - step + 1 + SIZE))
    return left, right


def _hashed(sums: np.ndarray, core: np.ndarray, step: int, left: np.ndarray, right: np.ndarray, salt: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Hashes of the core and of all bytes that a piece covers."""
    close = core - step + 1 + SIZE
    a = mix(hashes_from(sums, core, close) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mix(hashes_from(sums, core - left, close + right) + (left * step + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return pa.array(a.view(np.int64)), pa.array(b.view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, at, low, high, first, last``: every chosen place, the windows that chose it (they start
    ``low`` to ``high`` bytes before it) and the bytes that all windows around it cover."""
    names = ["doc_id", "text_key", "a", "b", "at", "low", "high", "first", "last"]
    for batch in batches:
        for row, texts in text_blocks(batch.column("text")):
            data, offsets = joined(texts)
            if len(data) < SIZE:
                continue
            sums = running_sums(data)
            begins = np.arange(len(data) - GRAM + 1)
            place = _sliding_places(hashes_from(sums, begins, begins + GRAM), REACH)
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(place)]
            window = np.flatnonzero(np.arange(len(place)) + SIZE <= offsets[doc + 1])
            place, doc = place[window], doc[window]
            change = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            until = np.r_[change[1:], len(window)] - 1
            at, doc = place[change], doc[change]
            left, right = _sides(at, REACH, offsets[doc], offsets[doc + 1])
            a, b = _hashed(sums, at, REACH, left, right, np.zeros(len(at), np.int64))
            origin, owner = offsets[doc], pa.array(row + doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(owner), batch.column("text_key").take(owner), a, b, pa.array(at - origin),
                    pa.array((at - window[until]).astype(np.int32)), pa.array((at - window[change]).astype(np.int32)),
                    pa.array(at - left - origin), pa.array(at + GRAM + right - origin),
                ],
                names=names,
            )


_ANCHOR = "doc_id long, text_key long, a long, b long, at long, low int, high int, first long, last long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, at, left, right``: the pieces of the windows of every open anchor, with the bytes on both sides
    of the core, which starts at ``at``."""
    names = ["doc_id", "text_key", "a", "b", "at", "left", "right"]
    for batch in batches:
        opened = batch.column("places")
        for row, texts in text_blocks(batch.column("text")):
            data, offsets = joined(texts)
            if len(data) < SIZE:
                continue
            part = opened.slice(row, len(texts))
            doc = np.repeat(np.arange(len(texts)), part.value_lengths().to_numpy())
            places = part.flatten()
            at, low, high = (places.field(f).to_numpy() for f in ("at", "low", "high"))
            steps = high // STEP - low // STEP + 1
            owner = np.repeat(np.arange(len(at)), steps)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps) + (low // STEP)[owner]
            doc = doc[owner]
            start, end = offsets[doc], offsets[doc + 1]
            core = at[owner] + start - turn * STEP
            left, right = _sides(core, STEP, start, end)
            whole = np.flatnonzero((left >= 0) & (right >= 0) & (left + right >= STEP - 1))
            core, left, right, turn, doc, start = (x[whole] for x in (core, left, right, turn, doc, start))
            a, b = _hashed(running_sums(data), core, STEP, left, right, turn + 1)
            close = core - STEP + 1 + SIZE
            rows = pa.array(row + doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("text_key").take(rows), a, b, pa.array(core - start),
                    _cut(data, core - left, core), _cut(data, close, close + right),
                ],
                names=names,
            )


_PIECE = "doc_id long, text_key long, a long, b long, at long, left binary, right binary"


def _cut(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of every span, as binary values."""
    sizes = ends - begins
    offsets = np.r_[0, np.cumsum(sizes)]
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(begins, sizes)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index].tobytes())])


def repeated_windows(cores: list[int], lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int] | None]:
    """For different pieces (number of their core and bytes on its sides): the first and last of their windows
    that another piece of the same core has, too, as bytes left of the core; None without any.

    One suffix array of all pieces: a window is a run of STEP symbols that holds the core's symbol.
    """
    text: list[int] = []
    middles = []
    for core, left, right in zip(cores, lefts, rights):
        text += [b + 2 for b in left]
        middles.append(len(text))
        text.append(258 + core)
        text += [b + 2 for b in right]
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text))
    symbols = np.array(text + [0] * STEP)
    # Which piece and how many bytes before its core a suffix starts; others start no window.
    member, before = np.full(len(order), -1), np.full(len(order), -1)
    for at, (middle, left, right) in enumerate(zip(middles, lefts, rights)):
        least = max(0, STEP - 1 - len(right))
        member[middle - len(left) : middle - least + 1] = at
        before[middle - len(left) : middle - least + 1] = np.arange(len(left), least - 1, -1)
    windows = order[member[order] >= 0]
    runs = symbols[windows[:, None] + np.arange(STEP)]
    same = (runs[1:] == runs[:-1]).all(axis=1)
    again = windows[np.r_[same, False] | np.r_[False, same]]
    low, high = np.full(len(cores), STEP), np.full(len(cores), -1)
    np.minimum.at(low, member[again], before[again])
    np.maximum.at(high, member[again], before[again])
    return [(int(x), int(y)) if y >= 0 else None for x, y in zip(low, high)]


def _sorted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over rows sorted by core; a core is never cut."""
    held: list[dict] = []
    size = 0

    def decided() -> pa.RecordBatch:
        numbers: dict[int, int] = {}
        cores = [numbers.setdefault(r["a"], len(numbers)) for r in held]
        found = repeated_windows(cores, [r["left"] for r in held], [r["right"] for r in held])
        rows = [(r, f) for r, f in zip(held, found) if f and r["n"] == 1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["place"]["doc_id"] for r, _ in rows], pa.int64()),
                pa.array([r["place"]["text_key"] for r, _ in rows], pa.int64()),
                pa.array([r["place"]["at"] - f[1] for r, f in rows], pa.int64()),
                pa.array([r["place"]["at"] - f[0] + SIZE for r, f in rows], pa.int64()),
            ],
            names=["doc_id", "text_key", "first", "last"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            if size >= SYMBOLS and row["a"] != held[-1]["a"]:
                yield decided()
                held, size = [], 0
            held.append(row)
            size += len(row["left"]) + len(row["right"]) + 2
    if held:
        yield decided()


_SPAN = "doc_id long, text_key long, first long, last long"


def _equal_windows(pieces: DataFrame) -> DataFrame:
    """The spans of pieces of hot cores: every window is a row, and equal ones are counted."""
    left, right = F.octet_length("left"), F.octet_length("right")
    each = pieces.select("*", F.explode(F.sequence(F.lit(STEP - 1) - F.least(right, F.lit(STEP - 1)), left)).alias("x"))
    side = F.concat(F.substr("left", left - F.col("x") + 1, F.col("x")), F.substr("right", F.lit(1), F.lit(STEP - 1) - F.col("x")))
    each = each.withColumn("side", side)
    each = materialize(each, "hot-windows")
    twice = each.groupBy("a", "x", "side").agg(F.count("*").alias("times")).where("times > 1")
    found = join_counted(each.where("n = 1"), ["a", "x", "side"], materialize(twice, "hot-repeats"), "times", "left_semi")
    spans = found.select("place.doc_id", "place.text_key", (F.col("place.at") - F.col("x")).alias("first"), (F.col("place.at") - F.col("x") + SIZE).alias("last"))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("s")).select(
        "doc_id", "text_key", F.explode("s").alias("s")
    ).select("doc_id", "text_key", "s.first", "s.last")


def _counted(rows: DataFrame, *more: str) -> DataFrame:
    """One row per different ``a, b``, with its count ``n``, the first place that has it, and one value of ``more``."""
    place = F.struct("doc_id", "text_key", "at")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("place"), *[F.any_value(c).alias(c) for c in more])


def _undecided(counted: DataFrame) -> DataFrame:
    """``a, members`` of the cores whose pieces differ and of which at least one occurs once."""
    sizes = counted.groupBy("a").agg(F.count("*").alias("members"), F.min("n").alias("least"))
    return sizes.where("members > 1 and least = 1").select("a", "members")


def _matched(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``texts`` with the columns of ``rows`` (``_id``, ``_key``, …) of the same document."""
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return texts.join(rows, same, how).drop("_id", "_key")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, first, last``: spans of bytes to remove, overlapping or not; ``text_key`` is a hash of
    the text, and rows with the same id and text have one key."""
    texts = _keyed(docs)
    anchors = materialize(texts.mapInArrow(_anchors, _ANCHOR), "anchors")
    counted = materialize(_counted(anchors), "anchor-counts")
    again = join_counted(anchors, ["a", "b"], counted.where("n > 1").select("a", "b", "n"), "n", "left_semi")
    spans = again.select("doc_id", "text_key", "first", "last")

    # One representative of every repeated anchor is enough to compare the others with.
    wanted = join_counted(counted, ["a"], materialize(_undecided(counted), "open-anchors"), "members", "left_semi").select("a", "b", "place.*")
    ranges = anchors.select("a", "b", "doc_id", "text_key", "at", "low", "high")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) if c == "doc_id" else F.col(f"w.{c}") == F.col(f"r.{c}") for c in ("a", "b", "doc_id", "text_key", "at")]
    opened = (
        ranges.alias("r").join(wanted.alias("w"), same, "left_semi")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_set(F.struct("at", "low", "high")).alias("places"))
    )
    pieces = materialize(_matched(texts, opened, "inner").mapInArrow(_pieces, _PIECE), "pieces")
    sides = materialize(_counted(pieces, "left", "right"), "piece-counts")
    twice = join_counted(pieces, ["a", "b"], sides.where("n > 1").select("a", "b", "n"), "n", "left_semi")
    left, right = F.octet_length("left"), F.octet_length("right")
    settled = twice.select(
        "doc_id", "text_key", (F.col("at") - left).alias("first"), (F.col("at") + (SIZE - STEP + 1) + right).alias("last")
    )
    undecided = materialize(_undecided(sides), "open-cores")
    open_sides = materialize(join_counted(sides, ["a"], undecided, "members"), "open-pieces")
    # By their number, since a suffix array is slow for its few bytes and small partitions would be merged.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-open_sides.count() // TASK_PIECES))
    small = open_sides.where(F.col("members") <= MEMBERS).repartition(parts, "a").sortWithinPartitions("a")
    sorted_out = small.select("a", "n", "place", "left", "right").mapInArrow(_sorted_pieces, _SPAN)
    return spans.union(settled).union(sorted_out).union(_equal_windows(open_sides.where(F.col("members") > MEMBERS)))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their marked bytes."""
    for batch in batches:
        kept, spans, sizes = [], [], []
        for text, marks in zip(batch.column("text").cast(pa.binary()), batch.column("marks")):
            text, merged = text.as_py(), []
            for mark in sorted((m["first"], m["last"]) for m in marks.as_py() or []):
                if merged and mark[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], mark[1])
                else:
                    merged.append(list(mark))
            edges = [0, *(at for span in merged for at in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else text)
            spans.append([{"first": a, "last": b} for a, b in merged])
            sizes.append(len(text))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
            names=["doc_id", "n_bytes", "kept", "spans"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, kept, spans``: every text as UTF-8 without the bytes of any run of SIZE bytes that also
    starts elsewhere, in the same document or another; ``spans`` are the removed runs, merged, in order.

    All occurrences go, also the first; runs are judged on the input.  What is kept may end inside a character,
    so it is binary.  NULL and empty texts, and those shorter than SIZE, lose nothing.  Repeated rows are
    copies of each other.  A NULL ``doc_id`` is a document, too; other columns are ignored; an empty table
    gives an empty table.  A single text is handled whole in one task.
    """
    marks = (
        materialize(repeated_spans(docs), "spans")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    )
    marked = _matched(_keyed(docs), marks, "left").select("doc_id", "text", "marks")
    return marked.mapInArrow(_reduced, "doc_id long, n_bytes long, kept binary, spans array<struct<first: long, last: long>>")


def digest(reduced: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`remove_repeats`."""
    removed: Column = F.col("n_bytes") - F.octet_length("kept")
    return reduced.select(
        "doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, octet_length(x) - 399)) AS pos FROM bytes WHERE octet_length(x) >= 400),
keyed AS (SELECT doc_id, pos, md5_number(x[pos + 1:pos + 400]) AS k FROM starts),
again AS (SELECT k FROM keyed GROUP BY 1 HAVING count(*) > 1),
hits AS (SELECT doc_id, pos FROM keyed JOIN again USING (k)),
parted AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER w <= 400 THEN 0 ELSE 1 END AS opens
           FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM parted),
spans AS (SELECT doc_id, no, min(pos) AS a, max(pos) + 400 AS b FROM numbered GROUP BY 1, 2),
before AS (SELECT doc_id, no, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY no), 0) AS e FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS removed,
         string_agg(hex(x[e + 1:a]), '' ORDER BY no) || hex(any_value(x)[max(b) + 1:octet_length(any_value(x))]) AS rest
  FROM before JOIN bytes USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN rest IS NULL THEN x ELSE unhex(rest) END) AS kept_sha256
FROM bytes d LEFT JOIN kept USING (doc_id)
"""

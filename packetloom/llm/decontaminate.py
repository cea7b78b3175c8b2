"""Benchmark decontamination by template windows.

Texts become runs of letters and runs of digits.  Numbers, names and units become typed slots, the
rest is lowered; every window of eight such tokens is hashed twice, once as it stands (literal) and
once with its slots (template, if at least half of it is no slot).  A window of a document that meets
a window of an item fixes an alignment of the two.  The slots of an alignment must map one to one from
the item's values to the document's values: then the document asks the same question with other
parameters.  Where they do not, only literal windows count.  A document that covers half of an item's
tokens or more is contaminated by it.

Document windows meet a bitmap of fixed size first, built from all benchmark windows; what passes is
joined by hash.  A benchmark that fills the bitmap makes the join larger, never the result wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.shingles import joined, span_hashes, windows
from packetloom.llm.support import materialize, text_blocks

WINDOW = 8
SHORTEST = 3
COVERED_PERCENT = 50
BITMAP_BITS = 1 << 24

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
# Words that count as numbers and units, and words that are no names when they begin a sentence.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
)
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros degree degrees percent"
)
COMMON_WORDS = (
    "a an the and or but if then when while what which who whom whose why where how is are was were be been do does did "
    "has have had can could will would shall should may might must of in on at to for from by with as that this these those "
    "it its he she they we you i his her their our your not no yes so there here each every all some any "
    "der die das ein eine und oder ist sind le la les un une et ou est sont el los las una y o es son"
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def _hashes_of(words: str) -> np.ndarray:
    data, starts = joined([w.encode() for w in words.split()])
    return np.sort(span_hashes(data, starts[:-1], starts[1:]))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


_NUMBERS, _UNITS, _COMMON = _hashes_of(NUMBER_WORDS), _hashes_of(UNIT_WORDS), _hashes_of(COMMON_WORDS)
_SLOT = np.random.default_rng(10).integers(0, 1 << 64, 4, np.uint64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every lowered token, its kind, and the first token of each text (one more at the end)."""
    data, starts = joined(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(starts), np.int64)
    after = np.r_[data[1:], np.uint8(0)]
    kind = _CLASS[data]
    # General punctuation (0xE2 0x80 and a third byte) parts words like ASCII punctuation does.
    quotes = np.flatnonzero((data == 0xE2) & (after == 0x80))
    for step in range(3):
        kind[np.minimum(quotes + step, len(kind) - 1)] = 0
    # Scripts without spaces (kana and ideographs, Thai and Lao): each character is a token of its own; their
    # punctuation (0xE3 0x80, and the full-width forms of ASCII punctuation) parts.
    wide = np.flatnonzero(((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)))
    third = data[np.minimum(np.arange(len(data)) + 2, len(data) - 1)]
    full = (data == 0xEF) & (((after == 0xBC) & ((third <= 0x8F) | (third >= 0x9A) & (third <= 0xA0))) | ((after == 0xBD) & (third >= 0x9B) & (third <= 0xA5)))
    for step in range(3):
        kind[np.minimum(np.flatnonzero(full | ((data == 0xE3) & (after == 0x80))) + step, len(kind) - 1)] = 0
    # Latin-1 capitals: 0xC3 and a second byte from 0x80 to 0x9E.
    capital = np.flatnonzero((data == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    lowered = np.where(_UPPER[data] == 1, data + 32, data).astype(np.uint8)
    lowered[capital + 1] += 32
    upper = _UPPER[data]
    upper[capital] = 1
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[starts] = True
    edge[wide] = edge[np.minimum(wide + 3, len(data))] = True
    cuts = np.flatnonzero(edge)
    begins, ends = cuts[:-1], cuts[1:]
    real = kind[begins] > 0
    begins, ends = begins[real], ends[real]
    digits = kind[begins] == 2
    # 1,000 and 3.5 are one number: later parts that a point or comma joins are taken in.
    inner = np.zeros(len(begins), bool)
    if len(begins) > 1:
        gap = (begins[1:] - ends[:-1] == 1) & np.isin(data[np.minimum(ends[:-1], len(data) - 1)], (44, 46))
        inner[1:] = gap & digits[1:] & digits[:-1] & (np.searchsorted(starts, begins[1:], "right") == np.searchsorted(starts, begins[:-1], "right"))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(starts), np.int64)
    first = np.flatnonzero(~inner)
    last = np.r_[first[1:], len(begins)] - 1
    begins, ends, digits = begins[first], ends[last], digits[first]
    hashes = span_hashes(lowered, begins, ends)
    sums = np.r_[0, np.cumsum(upper)]
    named = (upper[begins] == 1) & (sums[ends] - sums[begins] == 1) & (ends - begins > 1) & ~_among(hashes, _COMMON)
    kinds = np.where(digits | _among(hashes, _NUMBERS), NUMBER, np.where(_among(hashes, _UNITS), UNIT, np.where(named, NAME, LITERAL)))
    return hashes, kinds.astype(np.int8), np.searchsorted(begins, starts)


def keyed_windows(hashes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Literal and template key of every window; a template of mostly slots has key 0."""
    literal = windows(hashes, size) ^ np.uint64(size)
    template = windows(np.where(kinds > 0, _SLOT[kinds], hashes), size) ^ np.uint64(size + 256)
    slots = np.r_[0, np.cumsum(kinds > 0)]
    many = 2 * (slots[size:] - slots[:-size]) > size
    template[many] = 0
    return literal, template


_FIELDS = "id long, text_key long, n_tokens long, at long, key long, literal boolean, hashes array<long>, kinds array<tinyint>"
_ARROW = pa.schema(
    [("id", pa.int64()), ("text_key", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()), ("key", pa.int64()),
     ("literal", pa.bool_()), ("hashes", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8()))]
)


def _window_rows(rows: DataFrame, sizes: list[int], bitmap: np.ndarray | None) -> DataFrame:
    """Windows of ``id, text_key, text`` rows whose key is in the bitmap (all, without one).

    A text shorter than WINDOW is, on the benchmark side, one window of its own length.
    """
    held = rows.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value if held is not None else None
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("text_key")
            for first, texts in text_blocks(batch.column("text")):
                hashes, kinds, starts = tokens(texts)
                for size in sizes:
                    if len(hashes) < size:
                        continue
                    literal, template = keyed_windows(hashes, kinds, size)
                    at = np.arange(len(literal))
                    text = np.searchsorted(starts, at, "right") - 1
                    inside = at + size <= starts[text + 1]
                    if bits is None and size < WINDOW:
                        inside &= starts[text + 1] - starts[text] == size
                    for key, is_literal in ((literal, True), (template, False)):
                        chosen = inside & (key != 0)
                        if bits is not None:
                            place = key % np.uint64(BITMAP_BITS)
                            chosen &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                        chosen = np.flatnonzero(chosen)
                        if not len(chosen):
                            continue
                        of, span = text[chosen], chosen[:, None] + np.arange(size)
                        offsets = pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * size)
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(first + of)),
                                keys.take(pa.array(first + of)),
                                pa.array(starts[of + 1] - starts[of]),
                                pa.array(chosen - starts[of]),
                                pa.array(key[chosen].view(np.int64)),
                                pa.array(np.full(len(chosen), is_literal)),
                                pa.ListArray.from_arrays(offsets, pa.array(hashes[span].ravel().view(np.int64))),
                                pa.ListArray.from_arrays(offsets, pa.array(kinds[span].ravel())),
                            ],
                            schema=_ARROW,
                        )

    return rows.mapInArrow(run, _FIELDS)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of all benchmark keys; at most BITMAP_BITS / 64 words reach the driver, whatever the benchmark."""
    place = F.pmod(F.col("key"), F.lit(BITMAP_BITS))
    words = keys.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {BITMAP_BITS}), 64) as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[[r.word for r in rows]] = [r.bits for r in rows]
    return bitmap.view(np.uint64)


def _one_to_one(pairs: Column) -> Column:
    """Whether slots map values one to one within their kind."""
    there = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["item"])))
    back = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["doc"])))
    return (F.size(there) == F.size(pairs)) & (F.size(back) == F.size(pairs))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """``doc_id, text_key, item_id, n_tokens, n_covered, n_slots, n_changed`` of every document and item
    it contains: item tokens, tokens covered, distinct slots and those with another value.

    In scripts without spaces every character is a token.  NULL and empty texts have no windows, and items of fewer than three tokens match nothing; an item
    shorter than a window has to occur as a whole.  Repeated documents and items are reported once each
    by id and text.  Other columns are ignored; an empty table on either side gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    sizes = list(range(SHORTEST, WINDOW + 1))
    asked = materialize(_window_rows(items, sizes, None).distinct(), "item-windows")
    used = sorted(r[0] for r in asked.select(F.size("hashes")).distinct().collect())
    found = _window_rows(rows, used, _bitmap(asked.select("key")))
    left = found.select("key", F.col("id").alias("doc_id"), "text_key", F.col("at").alias("p"), F.col("hashes").alias("dh"), "literal")
    right = asked.select(
        "key", F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "n_tokens", F.col("at").alias("q"),
        F.col("hashes").alias("ih"), "kinds",
    )
    met = left.join(right, "key")
    zipped = F.zip_with(
        "kinds", F.arrays_zip("ih", "dh"), lambda k, v: F.struct(k.alias("kind"), v["ih"].alias("item"), v["dh"].alias("doc"))
    )
    spans = F.sequence("q", F.col("q") + F.size("kinds") - 1)
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    key = ["doc_id", "text_key", "item_id", "item_key", "n_tokens"]
    aligned = met.groupBy(*key, (F.col("p") - F.col("q")).alias("shift")).agg(
        merged(spans).alias("all_tokens"),
        merged(F.when(F.col("literal"), spans).otherwise(F.array().cast("array<long>"))).alias("same_tokens"),
        merged(F.filter(zipped, lambda s: s["kind"] > 0)).alias("pairs"),
    )
    fits = _one_to_one(F.col("pairs"))
    changed = F.size(F.filter("pairs", lambda s: s["item"] != s["doc"]))
    judged = aligned.select(
        *key,
        F.when(fits, F.col("all_tokens")).otherwise(F.col("same_tokens")).alias("tokens"),
        F.when(fits, F.size("pairs")).otherwise(0).alias("slots"),
        F.when(fits, changed).otherwise(0).alias("changed"),
    )
    summed = judged.groupBy(*key).agg(
        F.size(merged("tokens")).cast("long").alias("n_covered"),
        F.max("slots").cast("long").alias("n_slots"),
        F.max("changed").cast("long").alias("n_changed"),
    )
    return summed.where(100 * F.col("n_covered") >= percent * F.col("n_tokens")).drop("item_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark, percent).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"])
    return docs.join(bad, same, "left_anti")

"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full shingle sets.

Texts with equal shingle sets are one class and take part once.  Banded MinHash samples propose
candidates; the samples are also folded into a parity bitmap (an odd sketch), and the population
count of the XOR of two bitmaps estimates how far two sets differ.  Pairs that the estimate
cannot rule out are confirmed on full sets.

Large groups are not expanded into pairs.  First every member of a bucket meets only the smallest
member, and what that links is merged.  Then only buckets that still hold several components are
looked at again: sketches of members of different components are compared, full sets are fetched for
members with a candidate, and a bucket returns at most one link per member.  A bucket of more than BLOCK
members is first taken apart by bands twice as long, of samples of their own, so its rows grow with its
members and not with their square; what even those leave together meets in pairs of blocks.  Every pair that
shares a band is therefore either already connected or compared; two texts at the threshold share no band
with probability (1 - threshold^rows)^bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.shingles import mix, shingle_sets
from packetloom.llm.support import join_counted, materialize, text_blocks, texts_of

BANDS = 64
ROWS = 7
SAMPLES = 960
SKETCH_BITS = 2048
# Members of one bucket that meet in a task; larger buckets are taken apart by longer bands.
BLOCK = 4096
# Bands of larger buckets: two texts at a similarity of 0.8 share none with probability 1e-6.
LONG_BANDS = 307
LONG_ROWS = 14
# Candidate pairs per member beyond which a block confirms them itself.
DENSE = 3
# Standard deviations that a true link may lie off its estimate before it is missed.
SPREAD = 5.5
# Bits of the map of wanted documents that spares their texts a shuffle; more documents only make it coarser.
MAP_BITS = 1 << 22

_draw = np.random.default_rng(3)
_FACTOR = _draw.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _draw.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
_LONG_FACTOR = _draw.integers(0, 1 << 32, LONG_BANDS * LONG_ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
_LONG_SHIFT = _draw.integers(0, 1 << 32, LONG_BANDS * LONG_ROWS, np.uint64).astype(np.uint32)


def minhash(shingles: np.ndarray, factor: np.ndarray = _FACTOR, shift: np.ndarray = _SHIFT) -> np.ndarray:
    """The samples of one set: for each of the seeded orders, the smallest element's rank."""
    low = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for part in np.array_split(shingles, range(128, len(shingles), 128)):
        folded = (part >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, (folded[:, None] * factor + shift).min(axis=0, initial=0xFFFFFFFF), out=low)
    return low


def band_keys(samples: np.ndarray, bands: int = BANDS, length: int = ROWS) -> np.ndarray:
    """One key per band of the first samples, the band's number folded in; for a matrix, a row each."""
    samples = samples[..., : bands * length]
    rows = samples.reshape(*samples.shape[:-1], bands, length).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1000 * (length - ROWS)), rows.shape[:-1]).copy()
    for at in range(length):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[..., at])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of MinHash samples, a row per set: each (order, sample) flips one bit."""
    places = mix(samples.astype(np.uint64) + (np.arange(samples.shape[-1], dtype=np.uint64) << np.uint64(32)))
    places = (places % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(bits, (np.arange(len(samples))[:, None], places), 1)
    return np.packbits(bits & 1, axis=1).view(np.int64)


def estimated_similarity(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity that the XOR population count of two sketches estimates."""
    share = np.minimum(2.0 * differing_bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


def most_differing_bits(percent: int) -> int:
    """Population count beyond which two sets are not ``percent`` similar, SPREAD standard deviations off.

    The samples that differ are binomial and flip two bits each; the bitmap adds the noise of bits that
    meet.  Both variances add up.
    """
    miss = 1 - percent / 100
    flips = 2 * SAMPLES * miss
    stay = math.exp(-2 * flips / SKETCH_BITS)
    share = (1 - stay) / 2
    sampled = 2 * stay * math.sqrt(SAMPLES * miss * (1 - miss))
    return int(SKETCH_BITS * share + SPREAD * math.hypot(sampled, math.sqrt(SKETCH_BITS * share * (1 - share))))


def _signatures(width: int):
    fields = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sum_a", pa.int64()), ("sum_b", pa.int64()),
         ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in text_blocks(batch.column("text")):
                sets = shingle_sets(texts, width)
                samples = np.stack([minhash(s) for s in sets])
                full = [len(s) > 0 for s in sets]
                keys, sketches = band_keys(samples), odd_sketch(samples)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)),
                        *_sums(sets),
                        pa.array([list(k) if f else [] for k, f in zip(keys, full)], pa.list_(pa.int64())),
                        pa.array([list(s) for s in sketches], pa.list_(pa.int64())),
                    ],
                    schema=fields,
                )

    return run, "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set identity, band keys and odd sketch of every text."""
    run, schema = _signatures(width)
    return texts_of(docs).mapInArrow(run, schema)


_CLASS = ["n_shingles", "sum_a", "sum_b"]


def _sums(sets: list[np.ndarray]) -> list[pa.Array]:
    """What names a set: its size and two sums of its hashes."""
    both = np.array([(x.sum(), mix(x).sum()) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])]


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the classes in ``nodes`` (``node``, the class's name and its least ``doc_id``), written once.

    The texts are not shuffled for it: a bitmap of fixed size says which documents may be wanted, and the
    sets of those meet the classes by name, so an id with several texts gives each its own set.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    words = nodes.select(place("least_id").alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[[r.word for r in rows]] = [r.bits for r in rows]
    held = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy().astype(np.uint64)
            wanted = np.flatnonzero((held.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            batch = batch.take(pa.array(wanted))
            for _, texts in text_blocks(batch.column("text")):
                sets = shingle_sets(texts, width)
                offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*_sums(sets), values], names=[*_CLASS, "shingles"])

    found = texts_of(docs).select("text", place("doc_id").alias("at")).mapInArrow(
        run, "n_shingles long, sum_a long, sum_b long, shingles array<long>"
    )
    matched = found.join(nodes.select("node", *_CLASS), _CLASS).select("node", "shingles")
    return materialize(matched.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")


def _long_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, keys``: the long bands of every set."""
    for batch in batches:
        sets = [np.asarray(x.values).view(np.uint64) for x in batch.column("shingles")]
        keys = [band_keys(minhash(x, _LONG_FACTOR, _LONG_SHIFT), LONG_BANDS, LONG_ROWS) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "keys"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose full sets are ``percent`` similar."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    joined = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("a", "b"))
    return joined.select("u", "v", F.size("a").alias("a"), F.size("b").alias("b"), common.alias("common")).where(
        100 * F.col("common") >= percent * (F.col("a") + F.col("b") - F.col("common"))
    ).select("u", "v")


def _candidates(sketches: np.ndarray, sizes: np.ndarray, groups: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, later members (by set size) of other groups that size and sketch allow."""
    order = np.argsort(sizes, kind="stable")
    sketches, sizes, groups, limit = sketches[order], sizes[order], groups[order], most_differing_bits(percent)
    ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for at in range(len(order)):
        span = slice(at + 1, ends[at])
        if span.start < span.stop:
            near = np.bitwise_count(sketches[span] ^ sketches[at]).sum(axis=1, dtype=np.int64) <= limit
            near &= groups[span] != groups[at]
            if near.any():
                yield order[at], order[span][near]


_FOUND = ["key", "left", "right", "node", "other", "n_shingles", "component", "sketch"]


def _partners(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of rows of different components in one block that size and sketch allow.

    Rows are sorted by block and set size; each is compared with the one ``lag`` rows on, for all blocks at
    once, until no block is that long.  A block with few such pairs returns them (``node, other``); one with
    many returns its rows that have a partner, so results never outgrow the rows by more than DENSE.
    """
    sketches = np.stack(rows.sketch.to_list()).view(np.uint64)
    block, sizes, groups = rows.block.to_numpy(), rows.n_shingles.to_numpy(), rows.component.to_numpy()
    limit = most_differing_bits(percent)
    blocks = block.max() + 1
    most = DENSE * np.bincount(block, minlength=blocks)
    counts, chosen, found = np.zeros(blocks, np.int64), np.zeros(len(rows), bool), [np.zeros((0, 2), np.int64)]
    at = np.arange(len(rows) - 1)
    for lag in range(1, len(rows)):
        at = at[at < len(rows) - lag]
        at = at[(block[at] == block[at + lag]) & (sizes[at] * 100 >= sizes[at + lag] * percent)]
        if not len(at):
            break
        pairs = at[groups[at] != groups[at + lag]]
        for part in np.array_split(pairs, range(1 << 15, len(pairs), 1 << 15)):
            near = part[np.bitwise_count(sketches[part] ^ sketches[part + lag]).sum(axis=1, dtype=np.int64) <= limit]
            chosen[near] = chosen[near + lag] = True
            counts += np.bincount(block[near], minlength=blocks)
            # A block beyond its bound will return rows, so its pairs need not be held.
            near = near[counts[block[near]] <= most[block[near]]]
            found.append(np.stack([near, near + lag], axis=1))
    members = np.flatnonzero(chosen)
    dense = counts > DENSE * np.bincount(block[members], minlength=blocks)
    pairs = np.concatenate(found)
    few = pairs[~dense[block[pairs[:, 0]]]]
    many = rows.iloc[members[dense[block[members]]]].assign(other=pd.NA)[_FOUND]
    nodes = rows.node.to_numpy()
    single = pd.DataFrame({"node": nodes[few[:, 0]], "other": nodes[few[:, 1]]}).reindex(columns=_FOUND)
    return pd.concat([many, single.astype(object).where(single.notna(), None)], ignore_index=True)


def _with_partner(percent: int):
    """``_partners`` over rows sorted by block; a block that a batch cuts waits for its rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            named = rows[["key", "left", "right"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]).any(axis=1)])
            rows["block"] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
            whole = rows.iloc[: starts[-1]]
            held = rows.iloc[starts[-1] :].drop(columns="block")
            if len(whole):
                yield _partners(whole, percent)
        if held is not None and len(held):
            yield _partners(held.assign(block=0), percent)

    return run


def _block_links(percent: int):
    """A spanning set of confirmed links between the members of a block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("node").reset_index(drop=True)
        sketches = np.stack(block.sketch.to_list()).view(np.uint64)
        sets, nodes = list(block.shingles), block.node.to_numpy()
        heads = {c: c for c in block.component}

        def head(c: int) -> int:
            while heads[c] != c:
                heads[c] = heads[heads[c]]
                c = heads[c]
            return c

        found = []
        groups = block.component.to_numpy()
        for at, others in _candidates(sketches, block.n_shingles.to_numpy(), groups, percent):
            for other in others:
                a, b = head(groups[at]), head(groups[other])
                if a == b:
                    continue
                common = len(np.intersect1d(sets[at], sets[other], assume_unique=True))
                if 100 * common >= percent * (len(sets[at]) + len(sets[other]) - common):
                    heads[max(a, b)] = min(a, b)
                    found.append((nodes[at], nodes[other]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``width``-word shingles have ``100 * intersection >= percent * union``
    are linked; a component is named by its smallest ``doc_id``, which is the one kept.

    NULL and empty texts (or texts of white space) have an empty set and are linked with nothing;
    texts of fewer words than ``width`` have their whole word sequence as one shingle.  Every row is a
    text of its own, also where several rows have one id or none: a row's component is the smallest id
    among all rows it reaches (NULL if none of them has an id), whatever the order of the rows.  Columns
    other than ``doc_id`` and ``text`` are ignored.  An empty table gives an empty table.
    """
    signed = materialize(signatures(docs, width), "signatures")
    filled = signed.where("n_shingles > 0")
    # Equal sets are one node, with one of their equal signatures.
    classes = filled.groupBy(*_CLASS).agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")
    )
    # The ids are written with the rows, so a lost task does not change them.
    heads = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "heads")
    named = heads.select("node", "least_id", *_CLASS)
    banded = heads.select("node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    buckets = materialize(banded.join(pivots, "key").select("key", "node", "pivot"), "buckets")

    sketches = heads.select("node", "sketch", "n_shingles")
    limit = most_differing_bits(percent)
    stars = buckets.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    stars = (
        stars.join(sketches.toDF("u", "su", "nu"), "u").join(sketches.toDF("v", "sv", "nv"), "v")
        .where(F.col("nu") * 100 >= F.col("nv") * percent).where(F.col("nv") * 100 >= F.col("nu") * percent)
        .where(_differing_bits("su", "sv") <= limit).select("u", "v")
    )
    stars = materialize(stars, "stars")
    touched = stars.select(F.col("u").alias("node")).union(stars.select(F.col("v").alias("node"))).distinct()
    sets = _sets(docs, materialize(named.join(touched, "node", "left_semi"), "touched"), width)
    links = materialize(_confirmed(stars, sets, percent), "links")
    merged = components(links)

    # Buckets that still hold several components: members of the largest one need not meet each other.
    placed, shares = _open_buckets(buckets.select("key", "node"), merged)
    small = placed.join(shares.where(F.col("n") <= BLOCK), "key")
    crowded = placed.join(shares.where(F.col("n") > BLOCK), "key", "left_semi").select("node").distinct()
    crowded = materialize(named.join(crowded, "node", "left_semi"), "crowded")
    if not crowded.isEmpty():
        longer = _sets(docs, crowded, width).mapInArrow(_long_bands, "node long, keys array<long>")
        taken, parts = _open_buckets(materialize(longer.select("node", F.explode("keys").alias("key")), "long-bands"), merged)
        small = small.unionByName(taken.join(parts, "key"))
    blocks = _in_blocks(small).join(sketches, "node")
    found = materialize(
        blocks.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "n_shingles").mapInPandas(
            _with_partner(percent),
            "key long, left int, right int, node long, other long, n_shingles long, component long, sketch array<long>",
        ),
        "partners",
    )
    wanted = found.select("node").union(found.select(F.col("other").alias("node"))).where("node is not null").distinct()
    missing = materialize(named.join(wanted, "node", "left_semi").join(sets, "node", "left_anti"), "missing")
    if not missing.isEmpty():
        sets = sets.union(_sets(docs, missing, width))
    pairs = found.where("other is not null").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    dense = found.where("other is null").drop("other").join(sets, "node").groupBy("key", "left", "right")
    more = _confirmed(pairs, sets, percent).union(dense.applyInPandas(_block_links(percent), "u long, v long"))
    joined = materialize(components(links.union(more)), "components")

    # Components are named by ids at last.
    least = joined.join(named, "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = joined.join(least, "component").select("node", "component_id")
    final = heads.join(linked, "node", "left").select(*_CLASS, "copies", F.coalesce("component_id", "least_id").alias("component_id"))
    member = join_counted(filled.select("doc_id", *_CLASS), _CLASS, materialize(final, "final"), "copies").select("doc_id", "n_shingles", "component_id")
    rest = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_buckets(buckets: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of all buckets with their component, and the buckets that hold several: their largest one,
    ``main``, how many are of it, ``n_main``, and of all, ``n``."""
    placed = buckets.join(merged.select("node", F.col("component").alias("_c")), "node", "left").select(
        "key", "node", F.coalesce("_c", "node").alias("component")
    )
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    shares = counted.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    return placed, shares.where("groups > 1").select("key", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), "n")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``key, node, component, left, right``: a bucket of up to BLOCK members is one block; in a larger one,
    members of the largest component meet all others, and those meet each other, in pairs of blocks."""
    parts = lambda n: F.ceil(n / F.lit(BLOCK // 2)).cast("int")
    mains, others = parts(F.col("n_main")), parts(F.col("n") - F.col("n_main"))
    at_main, hashed = F.col("component") == F.col("main"), F.xxhash64("node")
    own = F.when(at_main, F.pmod(hashed, mains)).otherwise(mains + F.pmod(hashed, others)).cast("int")
    first = F.when(at_main, mains).otherwise(F.lit(0))
    one = F.col("n") <= BLOCK
    return (
        rows.withColumn("own", F.when(one, F.lit(0)).otherwise(own))
        .select("key", "node", "component", "own", F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(first, mains + others - 1))).alias("other"))
        .select("key", "node", "component", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    )


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, with all their columns.

    Of rows that repeat a document (same id and text) one stays.  Rows without an id cannot be named by
    a component and stay.
    """
    kept = near_duplicates(docs, width, percent).where("kept and doc_id is not null")
    named = materialize(kept.groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "_id"), "kept")
    single, several = named.where("n = 1"), named.where("n > 1")
    once = docs.join(single, docs["doc_id"] == single["_id"], "left_semi")
    more = docs.join(several, docs["doc_id"] == several["_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(more).union(docs.where(F.col("doc_id").isNull()))


def _differing_bits(left: str, right: str) -> Column:
    """Population count of the XOR of two sketches."""
    words = [F.bit_count(F.col(left)[at].bitwiseXOR(F.col(right)[at])) for at in range(SKETCH_BITS // 64)]
    return sum(words[1:], words[0])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE ws[pos:pos + 1] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), CASE WHEN len(ws) = 0 THEN 1 ELSE 2 END))) AS pos FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents
          UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
heads AS (SELECT u, min(v) AS head FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, head AS component_id, head = d.doc_id AS kept
FROM documents d JOIN heads h ON h.u = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

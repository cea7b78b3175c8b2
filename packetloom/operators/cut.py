"""Exact, seeded cuts of a table into parts of given sizes, independent of partitioning.

Rows are ordered by a 32-bit hash of a unique key, ties by the key.  With few classes, one scan counts
the rows of each class by the leading bits of their hash, which is all that reaches the driver; further scans
look only into the counts that a boundary falls in, until few rows are left, and the boundaries are literals of
a projection: no row is sorted, shuffled or joined.  With many classes or boundaries the histograms stay
DataFrames and the boundaries come back by class, in a broadcast while their number allows it, else in a join
that spreads large classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.hashing import HASH_BITS, key_hash
from packetloom.operators.skew import join_counted
from packetloom.session import materialize

# Copies of one row that one task produces at a time, and rows per partition of their table.
COPY_CHUNK = 10_000
PARTITION_ROWS = 1_000_000
COPY_COLUMN = "copy_no"
# Leading bits of the hash that a histogram on the driver refines at a time.
STEP_BITS = 12
# Classes and boundaries up to which the driver holds histograms and boundaries are literals.
FEW_CLASSES = 16
FEW_BOUNDS = 256
# Rows around all boundaries that are read instead of refined.
GATHER_ROWS = 20_000
# Leading bits of the hash in the first histogram of many classes; at most 2 ** BUCKET_BITS rows per class.
BUCKET_BITS = 16
# Classes whose boundaries are broadcast; each is a few numbers.
BROADCAST_CLASSES = 100_000

Sizes = dict[object, list[int]]
SizePlan = Callable[[dict[object, int]], Sizes]


def _located(histogram: DataFrame, bounds: DataFrame, within: list[str], order: list[Column]) -> DataFrame:
    """``bounds`` (with ``rank`` in their group) joined to the histogram row that holds that rank.

    ``rank`` becomes the rank among the rows of that histogram row, and ``n`` how many those are.
    """
    running = F.sum("n").over(W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    summed = histogram.withColumn("upto", running)
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in within]
    holds = (F.col("b.rank") <= F.col("h.upto")) & (F.col("b.rank") > F.col("h.upto") - F.col("h.n"))
    joined = summed.alias("h").join(bounds.alias("b"), [*same, holds])
    return joined.select("h.*", "b.index", (F.col("b.rank") - F.col("h.upto") + F.col("h.n")).alias("rank"))


def exact_cut(
    df: DataFrame,
    keys: list[str],
    sizes: SizePlan,
    by: str | None = None,
    seed: int = 42,
    part: str = "part",
) -> DataFrame:
    """Adds ``part`` (0, 1, …) so that each class has exactly the sizes planned for it.

    ``sizes`` maps the counts per class (``None`` when there is no ``by``) to the part
    sizes per class.  ``keys`` must be unique; ``number_copies`` makes them so for a
    table that has no key.  ValueError when a boundary falls among rows of one key.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    kind = T.IntegerType() if by is None else df.schema[by].dataType
    cls = F.lit(None).cast("int") if by is None else F.col(by)
    keyed = df.select(cls.alias("_cls"), key_hash(df, keys, seed).alias("_hash"), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    plain = all(isinstance(df.schema[k].dataType, T.AtomicType) for k in keys)
    coarse = _histogram(keyed, STEP_BITS, None) if plain else None
    if coarse is None:
        counts = {r["_cls"]: r["n"] for r in keyed.groupBy("_cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        counts = {c: sum(n for _, n in found) for c, found in coarse.items()}
    wanted, skipped = _wanted(counts, sizes(counts))
    columns = [F.col(f"`{c}`") for c in df.columns]
    if coarse is not None and len(wanted) <= FEW_BOUNDS:
        row = [key_hash(df, keys, seed), *[F.col(k) for k in keys]]
        types = [T.LongType(), *[df.schema[k].dataType for k in keys]]
        points = _literal_points(keyed, names, coarse, wanted)
        placed = F.lit(None).cast("int")
        for value in counts:
            own = F.lit(skipped[value])
            for point in points.get(value, []):
                own = own + _beyond(row, types, point).cast("int")
            placed = own if by is None else F.when(cls.eqNullSafe(F.lit(value).cast(kind)), own).otherwise(placed)
        return df.select(*columns, placed.cast("int").alias(part))
    return _by_class(df, keyed, keys, names, seed, kind, cls, counts, wanted, skipped, part, columns)


def _wanted(counts: dict[object, int], planned: Sizes) -> tuple[list[tuple[object, int, int]], Counter]:
    """Boundaries as (class, index, rows below), and how many leading parts of a class are empty."""
    wanted, skipped = [], Counter()
    for value, rows in counts.items():
        if sum(planned[value]) != rows:
            raise ValueError(f"part sizes of class {value!r} do not add up to its {rows} rows")
        taken = 0
        for index, size in enumerate(planned[value][:-1]):
            taken += size
            if 0 < taken < rows:
                wanted.append((value, index, taken))
            elif not taken:
                skipped[value] += 1
    return wanted, skipped


def _histogram(keyed: DataFrame, bits: int, inside: Column | None) -> dict[object, list[tuple[int, int]]] | None:
    """Per class the rows by the leading ``bits`` of their hash, ascending; None if there are many classes."""
    rows = keyed if inside is None else keyed.where(inside)
    most = max(FEW_CLASSES << STEP_BITS, FEW_BOUNDS << STEP_BITS if inside is not None else 0)
    counted = rows.groupBy("_cls", F.shiftright("_hash", HASH_BITS - bits).alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.limit(most + 1).collect()
    by_class: dict[object, list[tuple[int, int]]] = {}
    for r in found:
        by_class.setdefault(r["_cls"], []).append((r["_bucket"], r["n"]))
    if len(found) > most or inside is None and len(by_class) > FEW_CLASSES:
        return None
    return {c: sorted(held) for c, held in by_class.items()}


def _holding(histogram: list[tuple[int, int]], rank: int) -> tuple[int, int, int]:
    """The bucket that holds the ``rank``-th row, the rank in it and its rows."""
    for bucket, n in histogram:
        if rank <= n:
            return bucket, rank, n
        rank -= n
    raise ValueError("the rows changed between two scans")


def _literal_points(keyed: DataFrame, names: list[str], coarse: dict, wanted: list) -> dict[object, list[tuple]]:
    """The last ``(hash, key...)`` below each boundary, by class."""
    if not wanted:
        return {}
    types = {f.name: f.dataType for f in keyed.schema}
    bits = STEP_BITS
    open_ = [(value, *_holding(coarse[value], rank)) for value, _, rank in wanted]

    def inside() -> Column:
        """Rows in the buckets that hold a boundary."""
        found: dict[object, set[int]] = {}
        for value, bucket, _, _ in open_:
            found.setdefault(value, set()).add(bucket)
        prefix = F.shiftright("_hash", HASH_BITS - bits)
        condition = F.lit(False)
        for value, buckets in found.items():
            condition = condition | (F.col("_cls").eqNullSafe(F.lit(value).cast(types["_cls"])) & prefix.isin(sorted(buckets)))
        return condition

    while bits < HASH_BITS and sum(n for _, _, _, n in open_) > GATHER_ROWS:
        step = min(STEP_BITS, HASH_BITS - bits)
        finer = _histogram(keyed, bits + step, inside())
        open_ = [
            (value, *_holding([(b, n) for b, n in finer[value] if b >> step == bucket], rank)) for value, bucket, rank, _ in open_
        ]
        bits += step
    order = [F.col(c).asc_nulls_first() for c in ("_hash", *names)]
    rows = keyed.where(inside()).groupBy("_cls", "_hash", *names).agg(F.count(F.lit(1)).alias("n")).sort(*order).collect()
    points: dict[object, list[tuple]] = {}
    for value, bucket, rank, _ in open_:
        for r in rows:
            if r["_cls"] == value and r["_hash"] >> (HASH_BITS - bits) == bucket:
                if rank <= r["n"]:
                    if rank < r["n"]:
                        raise ValueError("the key is not unique at a cut; number the copies first")
                    points.setdefault(value, []).append((r["_hash"], *[r[n] for n in names]))
                    break
                rank -= r["n"]
    return points


def _beyond(row: list[Column], types: list[T.DataType], point: tuple) -> Column:
    """Whether a row comes after ``point``; the keys are looked at where the hashes are equal only."""
    keys = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(row[1:])])
    last = F.struct(*[F.lit(v).cast(t).alias(f"_{i}") for i, (v, t) in enumerate(zip(point[1:], types[1:]))])
    return (row[0] > F.lit(point[0])) | ((row[0] == F.lit(point[0])) & (keys > last))


def _by_class(
    df: DataFrame, keyed: DataFrame, keys: list[str], names: list[str], seed: int, kind: T.DataType, cls: Column,
    counts: dict[object, int], wanted: list, skipped: Counter, part: str, columns: list[Column],
) -> DataFrame:
    """The assignment for many classes: boundaries are a table, one row per class."""
    points = _cut_points(keyed, names, kind, wanted)
    fields = T.StructType([T.StructField("_class", kind), T.StructField("_empty", T.IntegerType()), T.StructField("_rows", T.LongType())])
    known = df.sparkSession.createDataFrame([(value, skipped[value], rows) for value, rows in counts.items()], fields)
    if points is not None:
        known = known.join(points, F.col("_class").eqNullSafe(F.col("_cls")), "left").drop("_cls")
    row = F.struct(key_hash(df, keys, seed).alias("_hash"), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    marked = df.select(F.struct(*columns).alias("_all"), cls.alias("_own"), row.alias("_row"))
    if len(counts) <= BROADCAST_CLASSES:
        joined = marked.join(F.broadcast(known), F.col("_own").eqNullSafe(F.col("_class")))
    else:
        # A NULL class is named by an extra column, so that the join is by equality.
        named = [F.col("_own").isNull().alias("_none"), F.coalesce(F.col("_own").cast("string"), F.lit("")).alias("_name")]
        known = known.select("*", F.col("_class").isNull().alias("_none"), F.coalesce(F.col("_class").cast("string"), F.lit("")).alias("_name"))
        joined = join_counted(marked.select("*", *named), ["_none", "_name"], materialize(known, "classes"), "_rows")
    passed = F.lit(0) if points is None else F.coalesce(F.size(F.filter("_points", lambda p: F.col("_row") > p)), F.lit(0))
    return joined.select(*[F.col(f"_all.`{c}`").alias(c) for c in df.columns], (F.col("_empty") + passed).cast("int").alias(part))


def _cut_points(keyed: DataFrame, names: list[str], kind: T.DataType, wanted: list[tuple[object, int, int]]) -> DataFrame | None:
    """``_cls, _points``: the last ``(hash, key…)`` below each boundary; None without boundaries."""
    if not wanted:
        return None
    fields = [T.StructField("_cls", kind), T.StructField("index", T.IntegerType()), T.StructField("rank", T.LongType())]
    bounds = keyed.sparkSession.createDataFrame(wanted, T.StructType(fields))
    bucket = F.shiftright("_hash", HASH_BITS - BUCKET_BITS).alias("_bucket")
    count = F.count(F.lit(1)).alias("n")
    coarse = keyed.groupBy("_cls", bucket).agg(count)
    bounds = materialize(_located(coarse, bounds, ["_cls"], [F.col("_bucket")]).drop("n", "upto"), "buckets")
    held = bounds.select(F.col("_cls").alias("_c"), F.col("_bucket").alias("_b")).distinct()
    inside = keyed.withColumn("_bucket", bucket).join(
        held, F.col("_cls").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")), "left_semi"
    )
    # Rows of one key collapse here, so a repeated key is one row.
    fine = inside.groupBy("_cls", "_bucket", "_hash", *names).agg(count)
    order = [F.col(c).asc_nulls_first() for c in ("_hash", *names)]
    found = materialize(_located(fine, bounds, ["_cls", "_bucket"], order), "points")
    if not found.where("rank < n").isEmpty():
        raise ValueError("the key is not unique at a cut; number the copies first")
    return found.groupBy("_cls").agg(F.collect_list(F.struct("_hash", *names)).alias("_points"))


def number_copies(df: DataFrame, copy: str = COPY_COLUMN) -> DataFrame:
    """Gives a keyless table a key: all its columns plus the number of the copy.

    Equal rows are counted with map-side combining and written once as (row, count); the
    copies are produced again on reading.  Rows with many copies are spread by chunks over
    as many partitions as the table's size asks for, so neither counting nor producing puts
    a repeated row into one task.
    """
    columns = df.columns
    counted = materialize(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")), "distinct")
    total = counted.agg(F.sum("_copies")).first()[0] or 0
    spread = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_ROWS))
    last = F.floor((F.col("_copies") - 1) / COPY_CHUNK)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # A number of partitions that is asked for is kept, however small the rows look before they multiply.
    chunks = chunks.repartition(spread, "_chunk", *columns)
    first = F.col("_chunk") * COPY_CHUNK
    final = F.least(first + COPY_CHUNK, F.col("_copies")) - 1
    return chunks.withColumn(copy, F.explode(F.sequence(first, final))).select(*columns, copy)


def split_sizes(rows: int, train_size: float) -> list[int]:
    """Floor for the training side, the rest for the test side; neither may be empty."""
    train = math.floor(train_size * rows)
    if train < 1 or train >= rows:
        raise ValueError(f"{rows} rows are too few for a training share of {train_size}")
    return [train, rows - train]


def holdout_sizes(rows: int, test_size: float) -> list[int]:
    """Ceiling for the test side, the rest for the training side."""
    test = math.ceil(test_size * rows)
    if test < 1 or test >= rows:
        raise ValueError(f"{rows} rows are too few for a test share of {test_size}")
    return [rows - test, test]


def class_key(cls: object) -> tuple:
    """Sort key for class values, NULL first."""
    return (cls is not None, cls)


def proportional_sizes(counts: dict[object, int], drawn: int) -> Sizes:
    """Splits ``drawn`` rows over the classes by largest remainder; ties go to the lower class."""
    total = sum(counts.values())
    if min(counts.values()) < 2:
        raise ValueError("a class with a single row cannot be on both sides of a stratified split")
    if min(drawn, total - drawn) < len(counts):
        raise ValueError("fewer rows than classes on one side of a stratified split")
    order = sorted(counts, key=class_key)
    shares = {c: divmod(counts[c] * drawn, total) for c in order}
    missing = drawn - sum(q for q, _ in shares.values())
    raised = set(sorted(order, key=lambda c: -shares[c][1])[:missing])
    return {
        c: [shares[c][0] + (c in raised), counts[c] - shares[c][0] - (c in raised)] for c in order
    }


def fold_sizes(rows: int, k: int) -> list[int]:
    """Near-equal folds; the first ``rows mod k`` get one more."""
    if k < 2 or k > rows:
        raise ValueError(f"cannot make {k} folds of {rows} rows")
    return [rows // k + (i < rows % k) for i in range(k)]


def stratified_fold_sizes(counts: dict[object, int], k: int) -> Sizes:
    """Deals the class-sorted rows round-robin to the folds, so folds are near-equal overall."""
    if k < 2 or k > max(counts.values()):
        raise ValueError(f"cannot make {k} folds: every class has fewer rows")

    def dealt(position: int, fold: int) -> int:
        return (position - fold + k - 1) // k

    sizes, start = {}, 0
    for cls in sorted(counts, key=class_key):
        end = start + counts[cls]
        sizes[cls] = [dealt(end, i) - dealt(start, i) for i in range(k)]
        start = end
    return sizes

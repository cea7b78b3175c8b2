"""Exact percentiles with bounded memory.

``percentile`` keeps every distinct value of a group in one buffer.  Here a rank is closed in
by counting passes around approximate quantiles until few rows are left, and only those
reach the driver.  Every pass excludes the values it has counted, so it always ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import materialize

GATHER_ROWS = 20_000
ACCURACY = 10_000


@dataclass(frozen=True)
class _Range:
    """Values strictly between two bounds (None: unbounded)."""

    low: float | None = None
    high: float | None = None

    def holds(self, value: Column) -> Column:
        condition = value.isNotNull()
        if self.low is not None:
            condition = condition & (value > F.lit(self.low))
        if self.high is not None:
            condition = condition & (value < F.lit(self.high))
        return condition


@dataclass
class _Rank:
    """The ``rank``-th smallest (0-based) of the ``rows`` values in ``inside``."""

    rank: int
    rows: int
    inside: _Range = _Range()
    value: float | None = None


def _close_in(df: DataFrame, value: Column, ranks: list[_Rank]) -> None:
    """One refinement of all open ranks: two passes over the column."""
    ranges = list({r.inside for r in ranks})
    slack = 2.0 / ACCURACY
    wanted = {}
    for span in ranges:
        spots = {r.rank / max(r.rows - 1, 1) for r in ranks if r.inside == span}
        wanted[span] = sorted({min(max(s + d, 0.0), 1.0) for s in spots for d in (-slack, slack)})
    quantiles = df.agg(
        *[
            F.percentile_approx(F.when(span.holds(value), value), wanted[span], ACCURACY).alias(f"q{i}")
            for i, span in enumerate(ranges)
        ]
    ).first()
    pivots = {span: sorted(set(quantiles[f"q{i}"])) for i, span in enumerate(ranges)}
    counters = []
    for i, span in enumerate(ranges):
        inside = span.holds(value)
        for j, pivot in enumerate(pivots[span]):
            counters.append(F.count_if(inside & (value < F.lit(pivot))).alias(f"b{i}_{j}"))
            counters.append(F.count_if(inside & (value == F.lit(pivot))).alias(f"e{i}_{j}"))
    counted = df.agg(*counters).first()
    for r in ranks:
        i, low = ranges.index(r.inside), r.inside.low
        start = 0
        for j, pivot in enumerate(pivots[r.inside]):
            below, equal = counted[f"b{i}_{j}"], counted[f"e{i}_{j}"]
            if r.rank < below:
                r.inside, r.rank, r.rows = _Range(low, pivot), r.rank - start, below - start
                break
            if r.rank < below + equal:
                r.value = pivot
                break
            low, start = pivot, below + equal
        else:
            r.inside, r.rank, r.rows = _Range(low, r.inside.high), r.rank - start, r.rows - start


def _gather(df: DataFrame, value: Column, ranks: list[_Rank]) -> None:
    """Reads the few rows around the open ranks."""
    condition = F.lit(False)
    for span in {r.inside for r in ranks}:
        condition = condition | span.holds(value)
    rows = df.filter(condition).groupBy(value.alias("v")).count().collect()
    values = sorted((row["v"], row["count"]) for row in rows)
    for r in ranks:
        left = r.rank
        for v, n in values:
            if (r.inside.low is not None and v <= r.inside.low) or (
                r.inside.high is not None and v >= r.inside.high
            ):
                continue
            if left < n:
                r.value = v
                break
            left -= n


def _windowed(df: DataFrame, value: Column, ranks: list[_Rank], bounds: list[float]) -> None:
    """Resolves ranks in one pass: counts between the windows and every value inside them.

    ``bounds`` are ascending window edges, a window being a pair of them.  A rank outside its
    window (which the accuracy of the quantiles rules out) stays open for the general way.
    """
    key, inside = F.lit(0), F.lit(False)
    for i, bound in enumerate(bounds):
        edge = value >= F.lit(bound) if i % 2 == 0 else value > F.lit(bound)
        key = F.when(edge, F.lit(i + 1)).otherwise(key)
    segment = F.col("segment")
    for i in range(1, len(bounds), 2):
        inside = inside | (segment == i)
    counted = df.filter(value.isNotNull()).select(key.alias("segment"), value.alias("v"))
    counted = counted.groupBy("segment", F.when(inside, F.col("v")).alias("v")).count().collect()
    rows = sorted((r["segment"], r["v"] if r["v"] is not None else -math.inf, r["count"]) for r in counted)
    for rank in ranks:
        left = rank.rank
        for number, v, n in rows:
            if left < n:
                rank.value = v if number % 2 else None
                break
            left -= n


def _edges(quantiles: list[float]) -> list[float]:
    """Disjoint ascending windows out of pairs of quantiles."""
    merged: list[list[float]] = []
    for low, high in sorted(zip(quantiles[::2], quantiles[1::2])):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [edge for window in merged for edge in window]


def exact_percentiles(df: DataFrame, requests: dict[str, list[float]]) -> dict[tuple[str, float], float | None]:
    """``{(column, p): value}`` for fractions ``p``, linearly interpolated; NULL and NaN are left out.

    Usually two passes: approximate quantiles around each fraction for all columns, then one
    per column that counts between them and reads the values inside.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in requests}
    numbers = df.select(*[v.alias(c) for c, v in values.items()])
    slack = 2.0 / ACCURACY
    first = []
    for name, fractions in requests.items():
        around = [min(max(p + d, 0.0), 1.0) for p in fractions for d in (-slack, slack)]
        first.append(F.count(name).alias(f"n_{name}"))
        first.append(F.percentile_approx(name, around, ACCURACY).alias(f"q_{name}"))
    measured = numbers.agg(*first).first()
    found: dict[tuple[str, float], float | None] = {}
    for name, fractions in requests.items():
        rows = measured[f"n_{name}"]
        if rows == 0:
            found |= {(name, p): None for p in fractions}
            continue
        wanted = {math.floor(p * (rows - 1)) for p in fractions}
        wanted |= {math.ceil(p * (rows - 1)) for p in fractions}
        ranks = {rank: _Rank(rank, rows) for rank in wanted}
        column, value = numbers.select(F.col(name).alias("v")), F.col("v")
        if GATHER_ROWS < rows and rows * 2 * slack * len(fractions) <= GATHER_ROWS:
            _windowed(column, value, list(ranks.values()), _edges(measured[f"q_{name}"]))
        if any(r.value is None and r.rows > GATHER_ROWS for r in ranks.values()):
            column = materialize(column, "values")  # several passes follow: compute the column once
        while large := [r for r in ranks.values() if r.value is None and r.rows > GATHER_ROWS]:
            _close_in(column, value, large)
        if open_ranks := [r for r in ranks.values() if r.value is None]:
            _gather(column, value, open_ranks)
        for p in fractions:
            spot = p * (rows - 1)
            low, high = ranks[math.floor(spot)].value, ranks[math.ceil(spot)].value
            found[name, p] = low + (high - low) * (spot - math.floor(spot))
    return found


def exact_percentile(df: DataFrame, column: str, p: float) -> float | None:
    return exact_percentiles(df, {column: [p]})[column, p]

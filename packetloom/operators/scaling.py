"""Standard scaling with the population standard deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.clean import as_double

SCALER_SCHEMA = "position INT, feature STRING, mean DOUBLE, std DOUBLE"


@dataclass(frozen=True)
class Scaler:
    """Mean and standard deviation per feature; a constant feature has std 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    rows: int = 0

    def scaled(self) -> list[Column]:
        """One expression per feature, in feature order, for a frame with DOUBLE features."""
        return [
            (F.col(name).cast("double") - F.lit(mean)) / F.lit(std)
            for name, mean, std in zip(self.features, self.means, self.stds)
        ]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *row) for i, row in enumerate(zip(self.features, self.means, self.stds))]
        return spark.createDataFrame(rows, SCALER_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> Scaler:
        rows = sorted(df.collect(), key=lambda r: r.position)
        return Scaler(
            tuple(r.feature for r in rows), tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows)
        )


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, mean, std)`` in one aggregation pass; std is the raw population value."""
    rows = [
        F.struct(
            F.lit(name).alias("feature"),
            F.avg(as_double(df, name)).alias("mean"),
            F.stddev_pop(as_double(df, name)).alias("std"),
        )
        for name in features
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def fit_scaler(df: DataFrame, features: list[str], check: bool = True) -> Scaler:
    """Fits from training rows; with ``check`` a missing or non-finite value is an error."""
    values = [as_double(df, name) for name in features]
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, value in enumerate(values):
        parts.append(F.avg(value).alias(f"mean{i}"))
        parts.append(F.stddev_pop(value).alias(f"std{i}"))
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        parts.append(F.count_if(bad).alias(f"bad{i}"))
    row = df.agg(*parts).first()
    if row["rows"] == 0:
        raise ValueError("no training rows")
    if check:
        bad = [name for i, name in enumerate(features) if row[f"bad{i}"]]
        if bad:
            raise ValueError(f"missing, NaN or infinite training values in: {', '.join(bad)}")
    means = tuple(row[f"mean{i}"] for i in range(len(features)))
    stds = tuple(row[f"std{i}"] or 1.0 for i in range(len(features)))
    return Scaler(tuple(features), means, stds, row["rows"])


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    """The features of ``scaler`` replaced by their scaled values."""
    return df.withColumns(dict(zip(scaler.features, scaler.scaled())))


def mean_square(columns: list[Column]) -> Column:
    total = columns[0] * columns[0]
    for column in columns[1:]:
        total = total + column * column
    return total / len(columns)

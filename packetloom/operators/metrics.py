"""Evaluation as aggregations over ``(label, prediction, score)`` tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.quantiles import exact_percentiles
from packetloom.schema import LABEL

# Metric names and their order in reports.
COMPARISON_METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
METRICS_SCHEMA = "metric STRING, value DOUBLE"
CLASSES = (0, 1)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """``(actual, predicted, n)`` with all four cells, from one aggregation pass."""
    cells = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(p).alias("predicted"),
            _count((F.col(label) == a) & (F.col(prediction) == p)).alias("n"),
        )
        for a in CLASSES
        for p in CLASSES
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def binary_metric_columns(label: str = LABEL, prediction: str = "prediction") -> dict[str, Column]:
    """Aggregate expressions; class 1 is the positive one."""
    y, p = F.col(label), F.col(prediction)
    hit, actual, predicted = _count((y == 1) & (p == 1)), _count(y == 1), _count(p == 1)
    return {
        "accuracy": _ratio(_count(y == p), F.count(F.lit(1))),
        "precision": _ratio(hit, predicted),
        "recall": _ratio(hit, actual),
        "f1_score": _ratio(2 * hit, actual + predicted),
    }


def binary_metrics(
    df: DataFrame, label: str = LABEL, prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1 as one row (per group of ``by``)."""
    columns = binary_metric_columns(label, prediction)
    return df.groupBy(*(by or [])).agg(*[c.alias(name) for name, c in columns.items()])


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For score-sorted rows: lowest score, class counts and correctly ordered pairs."""
    low, positives, negatives, pairs = None, 0.0, 0.0, 0.0
    for batch in batches:
        if batch.empty:
            continue
        pos, neg = batch["pos"].to_numpy(float), batch["neg"].to_numpy(float)
        below = negatives + np.cumsum(neg) - neg
        pairs += float(pos @ (below + neg / 2))
        low = batch["score"].iloc[0] if low is None else low
        positives, negatives = positives + pos.sum(), negatives + neg.sum()
    if low is not None:
        yield pd.DataFrame({"low": [low], "pos": [positives], "neg": [negatives], "pairs": [pairs]})


def roc_auc(df: DataFrame, label: str = LABEL, score: str = "score") -> float | None:
    """Exact area under the ROC curve, ties counted half; None with a single class.

    Rows of one score are counted first, so a score shared by many rows is one row of the
    sort.  Each range of scores then yields its counts and inner pairs, one row per task, and
    pairs between ranges follow from the counts.
    """
    y = F.col(label)
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    ranges = counts.repartitionByRange("score").sortWithinPartitions("score")
    rows = ranges.mapInPandas(_pair_sums, "low DOUBLE, pos DOUBLE, neg DOUBLE, pairs DOUBLE").collect()
    positives, negatives, pairs = 0.0, 0.0, 0.0
    for row in sorted(rows, key=lambda r: r.low):
        pairs += row.pairs + row.pos * negatives
        positives, negatives = positives + row.pos, negatives + row.neg
    return pairs / (positives * negatives) if positives and negatives else None


def classification_report(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and the two averages.

    The classes are few by nature; counts per (actual, predicted) pair come first, and all
    later steps work on those.
    """
    pairs = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    per_class = per_class.select(
        "cls",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1_score"),
        "support",
        "hit",
    )
    measures = ("precision", "recall", "f1_score")
    total = F.sum("support")
    summary_rows = [
        F.struct(
            F.lit("accuracy").alias("class"),
            *[_ratio(F.sum("hit"), total).alias(m) for m in measures],
            total.alias("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total.alias("support")
        ),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in measures],
            total.alias("support"),
        ),
    ]
    averages = per_class.agg(F.array(*summary_rows).alias("rows")).select(F.inline("rows"))
    detail = per_class.select(F.col("cls").cast("string").alias("class"), *measures, "support")
    return detail.unionByName(averages)


def error_distribution(df: DataFrame, mse: str = "mse", mae: str = "mae") -> dict[str, float | None]:
    """Location and spread of the per-row reconstruction errors."""
    moments = df.agg(
        F.avg(mse).alias("mse_mean"),
        F.stddev_pop(mse).alias("mse_std"),
        F.avg(mae).alias("mae_mean"),
        F.stddev_pop(mae).alias("mae_std"),
    ).first()
    quartiles = [0.25, 0.5, 0.75]
    spots = exact_percentiles(df, {mse: [*quartiles, 0.95], mae: quartiles})
    found = moments.asDict()
    for name, column in (("mse", mse), ("mae", mae)):
        low, middle, high = (spots[column, p] for p in quartiles)
        found[f"{name}_median"] = middle
        found[f"{name}_iqr"] = None if low is None else high - low
    found["mse_p95"] = spots[mse, 0.95]
    return found


def error_by_class(df: DataFrame, label: str = LABEL, mse: str = "mse", mae: str = "mae") -> DataFrame:
    """Mean errors of normal and anomalous rows; NULL for an absent class."""
    return df.agg(
        *[
            F.avg(F.when(F.col(label) == cls, F.col(error))).alias(f"avg_{name}_{word}")
            for name, error in (("mse", mse), ("mae", mae))
            for cls, word in ((0, "normal"), (1, "anomalous"))
        ]
    )


def evaluate_labelled(
    df: DataFrame, label: str = LABEL, prediction: str = "prediction", score: str = "score"
) -> dict[str, float | None]:
    found = binary_metrics(df, label, prediction).first().asDict()
    found["roc_auc"] = roc_auc(df, label, score)
    return found


def evaluate_errors(
    df: DataFrame, label: str | None = None, mse: str = "mse", mae: str = "mae", prediction: str = "prediction"
) -> dict[str, float | None]:
    """Error statistics; with a label also errors by class and the classification metrics."""
    found = error_distribution(df, mse, mae)
    if label is not None:
        found |= error_by_class(df, label, mse, mae).first().asDict()
        found |= evaluate_labelled(df, label, prediction, mse)
    return found


def metrics_frame(spark: SparkSession, metrics: dict[str, float | None]) -> DataFrame:
    rows = [(name, None if value is None else float(value)) for name, value in metrics.items()]
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def fold_summary(folds: DataFrame, metric: str = "metric", value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation per metric over the folds, NULLs left out.

    ``folds`` is a long table with a ``fold`` column numbered from 0; the metrics are those
    of the first fold.
    """
    keys = [*(by or []), metric]
    in_first = F.max((F.col("fold") == 0) & F.col(value).isNotNull())
    return (
        folds.groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), in_first.alias("_first"))
        .filter("_first")
        .drop("_first")
    )


def comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per model with the five metrics rounded to 4 places, and its error if it failed.

    ``metrics`` is long: ``(model, metric, value, error)``.
    """
    wide = [
        F.round(F.max(F.when(F.col("metric") == name, F.col("value"))), 4).alias(name)
        for name in COMPARISON_METRICS
    ]
    return metrics.groupBy("model").agg(*wide, F.max("error").alias("error"))


def top_features(importances: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest of a ``(feature, importance)`` table, ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)

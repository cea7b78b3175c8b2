"""Training, cross-validation and comparison of models."""

from __future__ import annotations

import logging
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.models.base import AnomalyModel
from packetloom.models.registry import build_model, model_class
from packetloom.operators.dataset import (
    assign_folds,
    assign_split,
    count_dropped,
    normal_only,
    parts_of,
)
from packetloom.operators.metrics import COMPARISON_METRICS, comparison_table, fold_summary
from packetloom.plans.extract import load_input
from packetloom.schema import LABEL
from packetloom.session import materialize
from packetloom.sources.paths import path_exists, unused_path
from packetloom.sources.sinks import write_document, write_table

log = logging.getLogger(__name__)

COMPARED_MODELS = ("autoencoder", "random_forest", "svm")
COMPARISON_SCHEMA = "model STRING, metric STRING, value DOUBLE, error STRING"
Parameters = dict[str, dict]


def _load(spark: SparkSession, data: DataFrame | str, needs_label: bool, label: str) -> DataFrame | None:
    """The input table; None, with the reason logged, when it cannot be trained on."""
    if isinstance(data, str):
        if not path_exists(spark, data):
            log.error("no input at %s", data)
            return None
        try:
            data = load_input(spark, data)
        except ValueError as error:
            log.error("unusable input: %s", error)
            return None
    if data.isEmpty():
        log.error("the input has no rows")
        return None
    if needs_label and label not in data.columns:
        log.error("the input has no label column %s", label)
        return None
    return data


def train_model(
    spark: SparkSession,
    name: str,
    data: DataFrame | str,
    output: str,
    label: str = LABEL,
    keys: list[str] | None = None,
    seed: int = 42,
    **parameters,
) -> tuple[AnomalyModel, dict[str, float | None]] | None:
    """Splits 80/20, fits, evaluates on the held-out part and saves below a free path."""
    model = build_model(name, **parameters)
    table = _load(spark, data, model.supervised, label)
    if table is None:
        return None
    split = assign_split(table, keys, label, None, 0.2, stratify=False, seed=seed)
    train, held = (part.drop(*(keys or [])) for part in parts_of(materialize(split, "split")))
    if not model.supervised and label in table.columns and not parameters.get("train_on_anomalous"):
        log.warning("%d rows that are not normal are left out of training", count_dropped(train, label))
    model.training_dataset = data if isinstance(data, str) else None
    model.fit(train, label)
    metrics = model.evaluate(held, label)
    model.save(spark, unused_path(spark, output), metrics)
    return model, metrics


def _fit_on(name: str, train: DataFrame, label: str, seed: int, parameters: dict) -> AnomalyModel:
    """Fits a fresh model; one without supervision sees 90% of the normal rows."""
    model = build_model(name, **parameters)
    if not model.supervised:
        if label in train.columns:
            train = normal_only(train, label)
        train = parts_of(assign_split(train, None, label, None, 0.1, stratify=False, seed=seed))[0]
    return model.fit(train, label)


def cross_validate(
    spark: SparkSession,
    name: str,
    data: DataFrame | str,
    k: int = 5,
    label: str = LABEL,
    keys: list[str] | None = None,
    seed: int = 42,
    parallelism: int = 2,
    **parameters,
) -> DataFrame | None:
    """``(model, metric, mean, std, k)`` over k folds; folds are stratified for supervised models."""
    supervised = model_class(name).supervised
    table = _load(spark, data, supervised, label)
    if table is None:
        return None
    folded = assign_folds(table, k, label if supervised else None, keys, seed)
    folded = materialize(folded.drop(*(keys or [])), "folds")

    @inheritable_thread_target(spark)
    def run(fold: int) -> list[tuple[int, str, float | None]]:
        train = folded.filter(F.col("fold") != fold).drop("fold")
        held = folded.filter(F.col("fold") == fold).drop("fold")
        metrics = _fit_on(name, train, label, seed, parameters).evaluate(held, label)
        return [(fold, metric, value) for metric, value in metrics.items()]

    with ThreadPool(min(parallelism, k)) as pool:
        rows = [row for result in pool.map(run, range(k)) for row in result]
    long = spark.createDataFrame(rows, "fold INT, metric STRING, value DOUBLE")
    summary = fold_summary(long)
    return summary.select(F.lit(name.lower()).alias("model"), "metric", "mean", "std", F.lit(k).alias("k"))


def compare_models(
    spark: SparkSession,
    data: DataFrame | str,
    output: str | None = None,
    test_size: float = 0.2,
    label: str = LABEL,
    keys: list[str] | None = None,
    seed: int = 42,
    models: tuple[str, ...] = COMPARED_MODELS,
    parameters: Parameters | None = None,
) -> DataFrame | None:
    """All models on one stratified split: a row each with five metrics, or with its error.

    With ``output`` also writes ``results.csv`` (gaps shown as N/A) and ``results.json``.
    """
    table = _load(spark, data, True, label)
    if table is None:
        return None
    split = assign_split(table, keys, label, None, test_size, stratify=True, seed=seed)
    train, test = (part.drop(*(keys or [])) for part in parts_of(materialize(split, "split")))
    rows: list[tuple] = []
    for name in models:
        try:
            metrics = _fit_on(name, train, label, seed, (parameters or {}).get(name, {})).evaluate(test, label)
            rows += [(name, metric, metrics.get(metric), None) for metric in COMPARISON_METRICS]
        except Exception as error:
            log.error("model %s failed: %s", name, error)
            rows.append((name, None, None, str(error)))
    comparison = comparison_table(spark.createDataFrame(rows, COMPARISON_SCHEMA)).orderBy("model")
    if output:
        shown = comparison.select(*[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in comparison.columns])
        write_table(shown.coalesce(1), f"{output}/results.csv")
        write_document(spark, [r.asDict() for r in shown.collect()], unused_path(spark, f"{output}/results.json"))
    return comparison

"""Scoring tables and forwarding their alerts."""

from __future__ import annotations

import logging
import posixpath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from packetloom.models.base import AnomalyModel
from packetloom.models.registry import build_model
from packetloom.operators.alerts import project_alerts
from packetloom.operators.clean import ADDRESS_COLUMNS
from packetloom.plans.extract import load_input
from packetloom.schema import LABEL
from packetloom.sources.sinks import write_alerts, write_table

log = logging.getLogger(__name__)


def score_table(model: AnomalyModel, df: DataFrame) -> DataFrame:
    """All feature columns with ``prediction`` and, from the autoencoder, ``anomaly_score``."""
    return model.transform(df.drop(*ADDRESS_COLUMNS, LABEL)).drop("score")


def detect(
    spark: SparkSession,
    model: AnomalyModel,
    df: DataFrame,
    model_name: str,
    output: str,
    alert_path: str | None = None,
    syslog_path: str | None = None,
    mode: str = "file",
    dry_run: bool = False,
    now: Column | None = None,
    file_format: str = "csv",
) -> tuple[DataFrame, int]:
    """Scores ``df``, writes it and forwards one alert per anomaly; returns table and count.

    Rows are scored in the single pass that writes them; alerts come from the written table.
    """
    if df.isEmpty():
        return df, 0
    scored, seen = score_table(model, df), Observation()
    counted = scored.observe(seen, F.count_if(F.col("prediction") == 1).alias("anomalies"))
    target = write_table(counted, output, file_format)
    reader = spark.read.schema(scored.schema)
    stored = reader.option("header", True).csv(target) if file_format == "csv" else reader.format(file_format).load(target)
    found = seen.get["anomalies"]
    log.info("%d anomalies in %s", found, target)
    if alert_path or syslog_path or dry_run:
        alerts = project_alerts(stored, model_name, model.model_type)
        write_alerts(alerts, alert_path, syslog_path, mode, dry_run, now=now)
    return stored, found


def detect_file(
    spark: SparkSession, model_type: str, model_path: str, input_path: str, output: str, **options
) -> tuple[DataFrame, int] | None:
    """Detection on a capture or CSV input; None, with the reason logged, when it is unusable."""
    model = build_model(model_type).load(spark, model_path)
    try:
        table = load_input(spark, input_path)
        if table.isEmpty():
            log.warning("no usable rows in %s", input_path)
            return None
        return detect(spark, model, table, posixpath.basename(model_path.rstrip("/")), output, **options)
    except (ValueError, FileNotFoundError) as error:
        log.error("unusable detection input: %s", error)
        return None

"""What every anomaly model has in common: fit, score, evaluate, save, load."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.clean import as_double
from packetloom.operators.metrics import evaluate_labelled
from packetloom.schema import LABEL, feature_columns
from packetloom.session import materialize
from packetloom.sources.paths import path_exists
from packetloom.sources.sinks import read_document, write_document


METADATA_SCHEMA = (
    "model_type STRING, input_dim INT, n_training_samples LONG, trained_at STRING, "
    "evaluation_metrics MAP<STRING, DOUBLE>, document STRING"
)


class AnomalyModel(ABC):
    """A model over named numeric columns that adds ``prediction`` and ``score``."""

    model_type = "model"
    supervised = True

    def __init__(self, **parameters: Any):
        self.parameters = parameters
        self.features: list[str] = []
        self.metadata: dict[str, Any] = {}
        self.training_rows = 0
        self.training_dataset: str | None = None
        self.trained_at: str | None = None

    def _fit(self, df: DataFrame, label: str | None) -> None:
        """Trains on a frame of DOUBLE features (and the label); a fixed rule has nothing to learn."""

    @abstractmethod
    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds INT ``prediction`` and DOUBLE ``score``."""

    def _save(self, spark: SparkSession, path: str) -> None:
        """Writes what the model learned below ``path``; the parameters are part of the metadata."""

    def _load(self, spark: SparkSession, path: str) -> None:
        """Reads back what ``_save`` wrote."""

    def fit(
        self,
        df: DataFrame,
        label: str | None = LABEL,
        features: list[str] | None = None,
        exclude: tuple[str, ...] = (),
    ) -> AnomalyModel:
        """Trains on all columns but the label, or on the named ones."""
        self.features = features or feature_columns(df.columns, label or LABEL, exclude)
        if self.supervised and (label is None or label not in df.columns):
            raise ValueError(f"{self.model_type} needs a label column to train on")
        kept = [as_double(df, name).alias(name) for name in self.features]
        if label is not None and label in df.columns:
            kept.append(F.col(label).cast("int").alias(LABEL))
        self._fit(df.select(*kept), LABEL if label in df.columns else None)
        self.trained_at = datetime.now(timezone.utc).isoformat()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores rows; features are matched by name and all input columns are kept."""
        if not self.features:
            raise ValueError("the model is neither trained nor loaded")
        missing = [name for name in self.features if name not in df.columns]
        if missing:
            raise ValueError(f"input lacks model features: {', '.join(missing)}")
        return self._transform(df.withColumns({name: as_double(df, name) for name in self.features}))

    def fit_transform(self, df: DataFrame, label: str | None = LABEL) -> DataFrame:
        return self.fit(df, label).transform(df)

    def evaluate(self, df: DataFrame, label: str | None = LABEL) -> dict[str, float | None]:
        """Metrics over labelled rows; the rows are scored once and only three columns kept."""
        scored = self.transform(df).select(F.col(label).cast("int").alias(LABEL), "prediction", "score")
        return evaluate_labelled(materialize(scored, "scored"))

    def describe(self) -> dict[str, Any]:
        """Facts about the trained model that its metadata should carry."""
        return {}

    def get_metadata(self, path: str | None = None) -> dict[str, Any]:
        fallback = {
            "model_type": self.model_type,
            "model_path": path,
            "input_dim": len(self.features) or None,
            "evaluation_metrics": {},
        }
        return self.metadata or fallback

    def metadata_frame(self, spark: SparkSession, path: str | None = None) -> DataFrame:
        """The metadata as a one-row table: model type, width, training size, metrics and text."""
        found = self.get_metadata(path)
        metrics = {k: v if v is None else float(v) for k, v in found["evaluation_metrics"].items()}
        row = (
            found["model_type"],
            found["input_dim"],
            found.get("n_training_samples"),
            found.get("trained_at"),
            metrics,
            json.dumps(found, indent=4),
        )
        return spark.createDataFrame([row], METADATA_SCHEMA)

    def save(self, spark: SparkSession, path: str, metrics: dict[str, Any] | None = None) -> str:
        """Writes parts and ``metadata`` below ``path``; every part is found relative to it."""
        self._save(spark, path)
        self.metadata = {
            "model_type": self.model_type,
            "input_dim": len(self.features),
            "features": self.features,
            "parameters": self.parameters,
            **self.describe(),
            "trained_at": self.trained_at,
            "n_training_samples": self.training_rows,
            "training_dataset": self.training_dataset,
            "evaluation_metrics": metrics or {},
        }
        write_document(spark, self.metadata, f"{path}/metadata")
        return path

    def load(self, spark: SparkSession, path: str) -> AnomalyModel:
        if not path_exists(spark, f"{path}/metadata"):
            raise FileNotFoundError(f"no model metadata under {path}")
        self.metadata = read_document(spark, f"{path}/metadata")
        if self.metadata["model_type"] != self.model_type:
            raise ValueError(f"{path} holds a {self.metadata['model_type']}, not a {self.model_type}")
        self.features = self.metadata["features"]
        self.parameters = self.metadata["parameters"]
        self.training_rows = self.metadata["n_training_samples"]
        self.trained_at = self.metadata["trained_at"]
        self.training_dataset = self.metadata["training_dataset"]
        self._load(spark, path)
        return self

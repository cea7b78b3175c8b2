"""Building a dataset: combine, balance, split, each step saved."""

from __future__ import annotations

import logging
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from packetloom.operators.dataset import balance_labels, dedup_rows, shuffled, split_dataset
from packetloom.schema import LABEL
from packetloom.session import materialize
from packetloom.sources.sinks import write_table
from packetloom.sources.tabular import load_numeric, load_text

log = logging.getLogger(__name__)


def combine_sources(
    spark: SparkSession, sources: list[str], schema: T.StructType | None = None
) -> DataFrame:
    """All readable sources united by column name, as numbers, without repeated rows.

    A source that cannot be opened is skipped with a warning; text that is no number is an
    error.  Nothing readable gives a table without columns.  Where a row came from plays no
    part, so equal rows of different files collapse.
    """
    readable = []
    for source in sources:
        try:
            load_text(spark, source)
            readable.append(source)
        except Exception as error:
            log.warning("skipped %s: %s", source, error)
    if not readable:
        log.warning("no readable source to combine")
        return spark.createDataFrame([], T.StructType([]))
    return dedup_rows(load_numeric(spark, readable, schema))


def _beside(path: str, suffix: str) -> str:
    stem, extension = posixpath.splitext(path)
    return f"{stem}_{suffix}{extension}"


def prepare_dataset(
    spark: SparkSession,
    output: str,
    sources: list[str] | None = None,
    table: DataFrame | None = None,
    balance: bool = False,
    split: bool = False,
    label: str = LABEL,
    seed: int = 42,
    keys: list[str] | None = None,
    file_format: str = "csv",
    schema: T.StructType | None = None,
) -> dict[str, str]:
    """Runs the chosen steps in order and returns the path written by each.

    Starts from ``sources`` (combined) or from ``table``.  Existing paths are never replaced.
    """
    written: dict[str, str] = {}
    if sources is not None:
        table = materialize(combine_sources(spark, sources, schema), "combined")
        written["combined"] = output = write_table(table, output, file_format)
    if table is None:
        raise ValueError("give sources to combine or a table to start from")
    if balance:
        table = materialize(balance_labels(table, label, seed, keys), "balanced")
        written["balanced"] = output = write_table(shuffled(table, seed), _beside(output, "balanced"), file_format)
    if split:
        train, test = split_dataset(table, label, seed=seed, keys=keys)
        written["train"] = write_table(train, _beside(output, "train"), file_format)
        written["test"] = write_table(test, _beside(output, "test"), file_format)
    if not written:
        log.warning("no dataset operation chosen")
    return written

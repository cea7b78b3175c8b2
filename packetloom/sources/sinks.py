"""Writing tables, documents and alerts."""

from __future__ import annotations

import json
import logging
import socket
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from packetloom.operators.alerts import DEFAULT_APP, render_alerts
from packetloom.sources.paths import unused_path
from packetloom.sources.quoted import CSV_OPTIONS

log = logging.getLogger(__name__)

ALERT_MODES = ("file", "syslog", "both")
# An alert file is closed before its next line would take it over this size.
ALERT_FILE_BYTES = 10 << 20


def write_table(df: DataFrame, path: str, file_format: str = "csv") -> str:
    """Writes to ``path``, or to a free name beside it; returns the path used."""
    target = unused_path(df.sparkSession, path)
    writer = df.write.mode("errorifexists").format(file_format)
    if file_format == "csv":
        writer = writer.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_OPTIONS)
    writer.save(target)
    return target


def write_document(spark: SparkSession, document: dict | list, path: str) -> None:
    """A driver-sized JSON document, pretty-printed, as a one-row text table."""
    text = json.dumps(document, indent=2)
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(path, lineSep="\n")


def read_document(spark: SparkSession, path: str) -> dict | list:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def dealt_to_files(lines: DataFrame, file_bytes: int) -> DataFrame:
    """Lines with ``file`` and ``place``: each partition fills its files in turn up to ``file_bytes``.

    A line that is longer than that has a file of its own.  No row leaves its partition.
    """

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = place = filled = 0
        for frame in frames:
            sizes = frame["value"].fillna("").str.encode("utf-8").str.len().to_numpy() + 1
            ends, files = np.cumsum(sizes), np.zeros(len(sizes), int)
            at = 0
            while at < len(sizes):
                before = ends[at - 1] if at else 0
                end = max(int(np.searchsorted(ends, before + file_bytes - filled, side="right")), at)
                if end == at and not filled:
                    end = at + 1
                files[at:end] = file
                filled += int(ends[end - 1] - before) if end > at else 0
                if end < len(sizes):
                    file, filled = file + 1, 0
                at = end
            yield frame.assign(file=files, place=np.arange(place, place + len(sizes)))
            place += len(sizes)

    return lines.mapInPandas(deal, "value STRING, file INT, place LONG")


def _append_lines(lines: DataFrame, path: str, file_bytes: int) -> None:
    """One folder ``file=n`` for the n-th file of every task, so that no file mixes two of them."""
    dealt = dealt_to_files(lines, file_bytes).sortWithinPartitions("file", "place")
    dealt.drop("place").write.mode("append").partitionBy("file").text(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``write_alerts`` left under ``path``."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def write_alerts(
    alerts: DataFrame,
    file_path: str | None = None,
    syslog_path: str | None = None,
    mode: str = "file",
    dry_run: bool = False,
    host: str | None = None,
    now: Column | None = None,
    app: str = DEFAULT_APP,
    file_bytes: int = ALERT_FILE_BYTES,
) -> bool:
    """Delivers alerts as JSON lines, syslog lines or both; True when one delivery worked.

    Files are closed by their size; ``read_alerts`` reads them.

    Each delivery is guarded on its own.  A dry run checks the mode and reports success
    without writing.
    """
    if mode not in ALERT_MODES:
        log.error("unknown alert mode %s", mode)
        return False
    targets = {"json": file_path} if mode in ("file", "both") else {}
    if mode in ("syslog", "both"):
        targets["syslog"] = syslog_path
    if dry_run:
        return True
    lines = render_alerts(alerts, host or socket.gethostname(), now, app=app)
    if len(targets) > 1:
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
    delivered = False
    for column, path in targets.items():
        try:
            if path is None:
                raise ValueError(f"no path given for {column} alerts")
            _append_lines(lines.select(F.col(column).alias("value")), path, file_bytes)
            delivered = True
        except Exception as error:
            log.error("alert delivery to %s failed: %s", path, error)
    if len(targets) > 1:
        lines.unpersist()
    return delivered

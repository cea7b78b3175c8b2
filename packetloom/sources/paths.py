"""Paths on whatever file system the session is configured for."""

from __future__ import annotations

import posixpath
from datetime import datetime, timezone

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    file_system, jvm_path = _file_system(spark, path)
    return file_system.exists(jvm_path)


def is_directory(spark: SparkSession, path: str) -> bool:
    file_system, jvm_path = _file_system(spark, path)
    return file_system.exists(jvm_path) and file_system.getFileStatus(jvm_path).isDirectory()


def unused_path(spark: SparkSession, path: str, now: datetime | None = None) -> str:
    """``path`` itself while free, else ``name_YYYYmmdd_HHMMSS_n`` beside it."""
    if not path_exists(spark, path):
        return path
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    stem, extension = posixpath.splitext(path)
    number = 1
    while path_exists(spark, candidate := f"{stem}_{stamp}_{number}{extension}"):
        number += 1
    return candidate


def make_directory(spark: SparkSession, path: str) -> None:
    file_system, jvm_path = _file_system(spark, path)
    file_system.mkdirs(jvm_path)


def delete_path(spark: SparkSession, path: str) -> None:
    file_system, jvm_path = _file_system(spark, path)
    file_system.delete(jvm_path, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly inside a folder; empty when there is none."""
    file_system, jvm_path = _file_system(spark, path)
    if not file_system.exists(jvm_path):
        return []
    return sorted(status.getPath().getName() for status in file_system.listStatus(jvm_path))

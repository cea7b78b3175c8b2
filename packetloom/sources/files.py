"""Listing files on the cluster's file system and reading bytes inside tasks."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, length)`` of matching files; contents are pruned, so nothing is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )


# Schemes of Hadoop's connectors and what Arrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gcs": "gs"}


def _opened(path: str, local_mode: str, method: str):
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, local_mode)
    if parts.scheme == "dbfs":
        return open(f"/dbfs{unquote(parts.path)}", local_mode)
    from pyarrow import fs

    file_system, inner = fs.FileSystem.from_uri(parts._replace(scheme=SCHEMES.get(parts.scheme, parts.scheme)).geturl())
    return getattr(file_system, method)(inner)


def open_binary(path: str):
    """A seekable stream for a local path or a URI of a store that Arrow knows, under Hadoop's names, too."""
    return _opened(path, "rb", "open_input_file")


def create_binary(path: str):
    """A stream that writes a new file at such a path; its folder has to exist."""
    return _opened(path, "wb", "open_output_stream")

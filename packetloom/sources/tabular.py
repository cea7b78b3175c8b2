"""CSV tables and directories of them."""

from __future__ import annotations

import csv
import io
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.clean import require_no_text, text_or_null
from packetloom.operators.dataset import combine
from packetloom.schema import FEATURE_SCHEMA, LABEL
from packetloom.session import materialize
from packetloom.sources.files import list_files
from packetloom.sources.paths import is_directory, path_exists
from packetloom.sources.quoted import CSV_OPTIONS, first_record, read_quoted

_KNOWN_TYPES = {f.name: f.dataType for f in FEATURE_SCHEMA} | {LABEL: T.IntegerType()}


def _first_record(path: str) -> list[str]:
    text = first_record(path).decode("utf-8-sig").rstrip("\r\n")
    return next(csv.reader(io.StringIO(text, newline="")), [])


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(header=[_first_record(p) for p in batch["path"]])


def _text_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def _read(spark: SparkSession, paths: str | list[str], header: list[str], infer: bool) -> DataFrame:
    """Files that share one header.  ``infer`` costs one more pass over the data."""
    reader = spark.read.options(header=True, pathGlobFilter="*.csv", **CSV_OPTIONS)
    if infer:
        return reader.option("inferSchema", True).csv(paths)
    return reader.schema(_text_schema(header)).csv(paths)


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field of these tables holds a line break: some line then has an odd number of quotes."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def load_text(spark: SparkSession, path: str, infer: bool = False, source: str | None = None) -> DataFrame:
    """One CSV file, or all ``*.csv`` directly inside a directory, united by column name, as text.

    Files are grouped by identical header, since one reader binds columns by position.
    Headers are read in tasks, once per file; the driver gets the distinct ones with their paths.
    Quoted fields may hold line breaks: one scan of the lines tells, and only tables that have any
    are cut into records by ``quoted`` (their columns stay text).  ``source`` names a column for the base
    name of each row's file.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    files = list_files(spark, path, "*.csv" if is_directory(spark, path) else "*")
    headers = materialize(files.mapInPandas(_headers, "path STRING, length LONG, header ARRAY<STRING>"), "headers")
    quoted = has_quoted_breaks(spark, path)
    # One reader per distinct header; Spark's reader needs the paths of each here, once.
    paths = F.lit(None).cast("array<string>") if quoted else F.collect_list("path")
    distinct = headers.groupBy("header").agg(F.min("path").alias("first"), paths.alias("paths")).collect()
    if not distinct:
        raise ValueError(f"no CSV files in {path}")
    for row in distinct:
        if not row.header:
            raise ValueError(f"empty CSV file: {row.first}")
    tables = []
    for row in sorted(distinct, key=lambda r: r.first):
        if quoted:
            own = headers.filter(F.col("header") == F.array(*map(F.lit, row.header)))
            tables.append(read_quoted(own.select("path", "length"), row.header, source))
            continue
        found = _read(spark, path if len(distinct) == 1 else sorted(row.paths), row.header, infer)
        tables.append(with_source_name(found, source) if source else found)
    return combine(tables) if len(tables) > 1 else tables[0]


def _number(name: str, data_type: T.DataType) -> Column:
    """Text as a number.  Whole numbers may be written with a fraction of zero, as in ``80.0``."""
    text = text_or_null(F.col(name))
    if isinstance(data_type, T.IntegralType):
        whole = F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))
        return whole.try_cast(data_type)
    return text.try_cast(data_type)


def typed(
    df: DataFrame,
    schema: T.StructType | None = None,
    others: T.DataType | None = None,
    text_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Text columns cast by name: after ``schema``, else as packet features, else to ``others``."""
    known = {f.name: f.dataType for f in schema} if schema else _KNOWN_TYPES
    casts = {}
    for f in df.schema:
        wanted = known.get(f.name, others)
        is_text = isinstance(f.dataType, T.StringType) and f.name not in text_columns
        if is_text and isinstance(wanted, T.NumericType):
            casts[f.name] = _number(f.name, wanted)
    return df.withColumns(casts) if casts else df


def load_dataset(
    spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False, source: str | None = None
) -> DataFrame:
    """CSV tables with the types declared in ``schema`` (or those of the packet features).

    Values that do not fit become NULL; other columns stay text until a caller asks for
    numbers.  ``infer`` asks for inferred types instead.
    """
    df = load_text(spark, path, infer, source)
    return df if infer else typed(df, schema)


def load_numeric(
    spark: SparkSession, paths: list[str], schema: T.StructType | None = None, text_columns: tuple[str, ...] = ()
) -> DataFrame:
    """CSV tables united as numbers; ValueError when any other value is none."""
    df = combine([load_text(spark, path) for path in paths])
    require_no_text(df, [c for c in df.columns if c not in text_columns])
    return typed(df, schema, T.DoubleType(), text_columns)


def with_source_name(df: DataFrame, name: str = "source") -> DataFrame:
    """Adds the base name of the file each row came from."""
    return df.withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def file_suffix(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lower()

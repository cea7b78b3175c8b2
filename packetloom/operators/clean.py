"""Cleaning of numeric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.schema import LABEL

ADDRESS_COLUMNS = ("src", "dst")

# The text cells that CSV readers of the pandas family take as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def finite_or_null(column: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    return F.when(~(F.isnan(column) | (F.abs(column) == F.lit(float("inf")))), column)


def text_or_null(column: Column) -> Column:
    """Trimmed text with the missing-value tokens turned into NULL."""
    trimmed = F.trim(column)
    return F.when(~trimmed.isin(*MISSING_TOKENS), trimmed)


def as_double(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE; text that is no number becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return text_or_null(F.col(name)).try_cast("double")
    return F.col(name).cast("double")


def cast_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Casts decimals and text among ``columns`` to DOUBLE; integers and floats are left."""
    casts = {
        f.name: as_double(df, f.name)
        for f in df.schema
        if f.name in columns and isinstance(f.dataType, (T.DecimalType, T.StringType))
    }
    return df.withColumns(casts) if casts else df


def clean_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Non-finite values to NULL, rows without any number dropped, remaining NULLs to 0.

    ``columns`` are the declared numeric columns (by default those numeric by schema).
    The outcome of a row depends on that row alone, never on its batch.
    """
    df = df.drop(*ADDRESS_COLUMNS)
    columns = columns or numeric_columns(df)
    df = cast_numeric(df, columns)
    fractional = [c for c in columns if is_fractional(df, c)]
    if fractional:
        df = df.withColumns({c: finite_or_null(F.col(c)) for c in fractional})
    return df.dropna(how="all", subset=columns).fillna(0, subset=columns)


def attach_label(df: DataFrame, label: int | None, name: str = LABEL) -> DataFrame:
    """Adds the class literal, or nothing when no label is given."""
    return df if label is None else df.withColumn(name, F.lit(label).cast("int"))


def invalid_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, n_null, n_nan, n_infinite)`` from one aggregation pass."""
    aggregates = []
    for name in columns:
        value = as_double(df, name)
        aggregates.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count_if(value.isNull()).alias("n_null"),
                F.count_if(F.isnan(value)).alias("n_nan"),
                F.count_if(F.abs(value) == F.lit(float("inf"))).alias("n_infinite"),
            )
        )
    return df.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows"))


def numeric_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, n_violations)``: non-missing values that are no numbers."""
    counts = []
    for name in columns:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            present = text_or_null(value)
            bad = F.count_if(present.isNotNull() & present.try_cast("double").isNull())
        else:
            bad = F.count_if(value.isNotNull() & value.try_cast("double").isNull())
        counts.append(F.struct(F.lit(name).alias("column_name"), bad.alias("n_violations")))
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def require_no_text(df: DataFrame, columns: list[str]) -> None:
    """ValueError naming the columns that hold values which are no numbers."""
    found = numeric_violations(df, columns).filter("n_violations > 0").collect()
    if found:
        detail = ", ".join(f"{r.column_name} ({r.n_violations})" for r in found)
        raise ValueError(f"non-numeric values in: {detail}")


def require_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with ``columns`` as numbers, after that check."""
    require_no_text(df, columns)
    return cast_numeric(df, columns)

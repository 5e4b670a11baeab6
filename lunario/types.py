"""Column kinds and the checks that steps make before they plan anything. Only the schema is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = (*INTEGRAL, *FRACTIONAL, T.DecimalType)
CATEGORICAL = (T.StringType, T.BooleanType)
TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(df: DataFrame, column: str) -> T.DataType:
    """The type of a column; an unknown column is an error."""
    if column not in df.columns:
        raise ValueError(f"Column {column} is not a column")
    return df.schema[column].dataType


def is_numeric(df: DataFrame, column: str, strict: bool = False) -> bool:
    """Numeric columns; decimals count unless ``strict``."""
    t = kind_of(df, column)
    return isinstance(t, NUMERIC) and not (strict and isinstance(t, T.DecimalType))


def is_categorical(df: DataFrame, column: str) -> bool:
    return isinstance(kind_of(df, column), CATEGORICAL)


def is_time(df: DataFrame, column: str) -> bool:
    return isinstance(kind_of(df, column), TIME)


def is_window(df: DataFrame, column: str) -> bool:
    """A struct of ``start`` and ``end`` times."""
    t = kind_of(df, column)
    return isinstance(t, T.StructType) and [f.name for f in t.fields] == ["start", "end"] and all(isinstance(f.dataType, TIME) for f in t.fields)


def need_columns(df: DataFrame, columns: Iterable[str]) -> None:
    for c in columns:
        kind_of(df, c)


def need_numeric(df: DataFrame, columns: Iterable[str], word: str = "numeric") -> None:
    for c in columns:
        if not is_numeric(df, c):
            raise ValueError(f"Column {c} is not a {word} column")


def need_time(df: DataFrame, columns: Iterable[str]) -> None:
    for c in columns:
        if not is_time(df, c):
            raise ValueError(f"Column {c} is not a timestamp column")


def need_rows(df: DataFrame, message: str = "Empty DataFrame") -> None:
    """At least one row; reads no more than one."""
    if df.isEmpty():
        raise ValueError(message)

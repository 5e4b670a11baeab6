"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = "|") -> DataFrame:
    """Delimited text with a header, in UTF-8; without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", "utf-8")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = "|", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)

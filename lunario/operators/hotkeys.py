"""Results per key where a few keys hold most rows: values are counted before keys are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.functions.cumulative import percentile_columns
from lunario.session import shared_path


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): each distinct pair once, with the number of its rows.

    Rows of a hot key are combined before the shuffle and spread by value, so no task has a key to itself. Null keys
    and null or NaN values are kept as such.
    """
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).groupBy("key", "value").agg(F.count("*").alias("weight"))


def per_key(df: DataFrame, key: str, value: str, *, per_thousand: Sequence[int] = (), numeric: bool = True) -> DataFrame:
    """One row per key, from weighted values: row count, exact distinct count, mode, and percentiles where asked for.

    Columns: the key, ``n_righe`` (all rows), ``n_valori`` (rows with a value), ``n_distinti``, ``moda`` (most
    frequent value, of equally frequent ones the least) with ``n_moda``, and ``pNNN`` for each N of ``per_thousand``
    (first value that reaches the rank). Null and NaN values count in ``n_righe`` only. A null key is a key of its
    own. Keys without a value have null modes and percentiles. An empty table gives no rows.
    """
    pairs = compress(df, key, value)
    if per_thousand:  # two results need them; written once, the rows are read once
        pairs.write.parquet(kept := shared_path(df.sparkSession, "coppie"))
        pairs = df.sparkSession.read.parquet(kept)
    valid = F.col("value").isNotNull()
    if numeric:
        valid = valid & ~F.isnan(F.col("value").cast("double"))
    pairs = pairs.withColumn("ok", valid)
    by_key = pairs.groupBy("key").agg(
        F.sum("weight").alias("n_righe"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("weight"))), F.lit(0)).alias("n_valori"),
        F.count(F.when(F.col("ok"), 1)).alias("n_distinti"),
        F.min(F.when(F.col("ok"), F.struct((-F.col("weight")).alias("w"), F.col("value")))).alias("_top"),
    )
    out = by_key.select("key", "n_righe", "n_valori", "n_distinti", F.col("_top.value").alias("moda"), (-F.col("_top.w")).alias("n_moda"))
    if per_thousand:
        p = percentile_columns(pairs, "key", "value", "weight", per_thousand).drop("n").withColumnRenamed("key", "_key")
        out = out.join(p, out["key"].eqNullSafe(p["_key"]), "left").drop("_key")
    return out.withColumnRenamed("key", key)


def heavy_keys(df: DataFrame, key: str, value: str, least_share: tuple[int, int] = (1, 100)) -> DataFrame:
    """Non-null keys that hold at least ``least_share`` of all rows of ``df``, with their row count.

    Counts come from :func:`per_key`. A table without rows has no heavy key.
    """
    num, den = least_share
    total = df.select(F.count("*")).scalar()
    keys = per_key(df, key, value).select(key, "n_righe").where(F.col(key).isNotNull())
    return keys.where(F.col("n_righe") * den >= total * num)

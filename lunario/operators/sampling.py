"""Samples of rows and of whole series, and splits that lose no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.functions.cumulative import percentile_columns


def sample_rows(df: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` rows at random; all rows if there are no more. A top-k over random keys: each task keeps ``count`` rows at most."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(count).drop("_r")


def sample_series(df: DataFrame, identifier: str, count: int, seed: int = 0) -> DataFrame:
    """All rows of ``count`` entities, chosen by a hash of the identifier; the same for the same seed whatever the partitioning."""
    chosen = df.select(identifier).distinct().orderBy(F.xxhash64(F.lit(seed), identifier), identifier).limit(count)
    return df.join(chosen, identifier, "left_semi")


def random_split(df: DataFrame, test_size: float = 0.3, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    train, test = df.randomSplit([1 - test_size, test_size], seed)
    return train, test


def value_buckets(df: DataFrame, value: str, width: float = 100, column: str = "bucket") -> DataFrame:
    """The number of the bucket of equal width in which a value lies; negative values have negative numbers, NaN and null none."""
    v = F.col(value).cast("double")
    return df.withColumn(column, F.when(~F.isnan(v), F.floor(v / width).cast("bigint")))


def stratified_split(df: DataFrame, value: str, test_size: float = 0.3, width: float = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): of every value bucket the share ``test_size`` is tested; rows without a number are a bucket too.

    Rows are ordered by a hash of all their columns, and a bucket's first ones are tested, so the same row is on the
    same side however often and in whatever order it is read; equal rows stay together. The last hash that is tested
    is the bucket's percentile, which is found without gathering a bucket anywhere.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    own = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 52))
    tagged = value_buckets(df, value, width, "_b").withColumn("_h", own)
    counts = tagged.groupBy("_b", "_h").agg(F.count("*").alias("_w"))
    last = percentile_columns(counts, "_b", "_h", "_w", [p := round(test_size * 1000)]).select(F.col("_b").alias("_b2"), F.col(f"p{p:03d}").alias("_last"))
    joined = tagged.join(last, F.col("_b").eqNullSafe(F.col("_b2")))
    return tuple(joined.where(side).select(*[F.col(f"`{c}`") for c in df.columns]) for side in ("_h > _last", "_h <= _last"))


def stratified_histogram(df: DataFrame, value: str, width: float = 100, above: int | None = None, below: int | None = None) -> DataFrame:
    """(bucket, count), of the buckets strictly above and below the given numbers; rows without a number have no bucket."""
    h = value_buckets(df, value, width).where("bucket is not null").groupBy("bucket").count()
    h = h if above is None else h.where(F.col("bucket") > above)
    return h if below is None else h.where(F.col("bucket") < below)

"""Percentiles per group with a stated error, from states that may be combined across days, files or partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lunario.functions.cleaning import number_or_null
from lunario.functions.cumulative import percentile_columns


def representative(value: Column, relative_error: float) -> Column:
    """The value that stands for all within ``relative_error`` of it; 0 for 0, the value itself if the error is 0.

    Magnitudes are cut at powers of (1 + e) / (1 - e); the value named for a cell is off by at most e times any in it.
    """
    if relative_error <= 0:
        return value
    base = (1 + relative_error) / (1 - relative_error)
    cell = F.ceil(F.log(F.abs(value)) / F.lit(math.log(base))).cast("int")
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * F.lit(2 / (1 + base)) * F.pow(F.lit(base), cell))


def state(df: DataFrame, group: Sequence[Column], value: Column, relative_error: float) -> DataFrame:
    """Group-value counts: the group columns, ``valore`` (representative) and ``n``.

    Null, NaN and infinite values are left out; null groups are a group. Counted before the shuffle, so a group with
    a third of all rows is as many rows as it has representatives. With error e and magnitudes between a and b a group
    has at most 2 ln(b/a) / ln((1+e)/(1-e)) of them, whatever the number of rows.
    """
    rows = df.select(*group, representative(number_or_null(value), relative_error).alias("valore")).where("valore is not null")
    return rows.groupBy(*[c for c in rows.columns]).agg(F.count("*").alias("n"))


def combine(states: Sequence[DataFrame], group: str) -> DataFrame:
    """One state of several with the same error: counts of equal group and value are added; other columns are dropped."""
    together = reduce(DataFrame.unionByName, [s.select(group, "valore", "n") for s in states])
    return together.groupBy(group, "valore").agg(F.sum("n").alias("n"))


def percentiles(combined: DataFrame, group: str, per_thousand: Sequence[int], relative_error: float) -> DataFrame:
    """One row per group: ``n``, a column ``pNNN`` per percentile, and ``errore``, the bound of their relative error.

    The percentile is the first value whose cumulative frequency reaches the rank ceil(N/1000 x n). Ranks are exact;
    only the value is rounded, to within ``errore`` times its magnitude. Groups without a number give no row.
    """
    return percentile_columns(combined, group, "valore", "n", per_thousand).withColumn("errore", F.lit(float(relative_error)))

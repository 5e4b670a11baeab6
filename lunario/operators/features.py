"""Features of every entity's series: one row per entity, one shuffle, columns known before any data is read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.functions.naming import plain_name
from lunario.functions.series import catalog
from lunario.functions.series.arrays import PARAMETERS, evaluate
from lunario.functions.series.sql import AGGREGATES, ARRAYS, BASE, label
from lunario.session import shared_path
from lunario.types import need_columns, need_numeric, need_time


def unpivot_series(df: DataFrame, identifier: str, time: str, values: Sequence[str] | None = None) -> DataFrame:
    """(identifier, time, ``kind``, ``value`` double): one row per series column."""
    columns = [c for c in df.columns if c not in (identifier, time)] if values is None else list(values)
    need_numeric(df, columns, "numerical")
    doubles = df.select(identifier, time, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([identifier, time], columns, "kind", "value")


def drop_null_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns that hold any null; the counts are taken in one pass."""
    columns = [c for c in df.columns if c not in keep]
    if not columns:
        return df
    # 60 columns share one number whose bits are set by nulls, so that wide tables need few aggregates. As text: a
    # table of thousands of columns would take minutes of calls to the JVM, expression by expression.
    parts = [columns[i : i + 60] for i in range(0, len(columns), 60)]
    bits = ["coalesce(bit_or(" + " | ".join(f"if(`{c}` is null, {1 << k}L, 0L)" for k, c in enumerate(p)) + "), 0L)" for p in parts]
    seen = df.selectExpr(*bits).first()
    gone = {c for p, mask in zip(parts, seen, strict=True) for k, c in enumerate(p) if mask >> k & 1}
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in gone])


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*map(plain_name, df.columns))


@dataclass
class FeatureGenerating:
    """``{column}__{calculator}`` columns for every numeric column of a filled series.

    ``excluded_cols_name`` are not series: their value at an entity's least time comes along (``representative``).
    Null and NaN values are not part of a series. Rows of one time keep an order by value. Features that are null for
    any entity are dropped if ``drop_nulls``, which writes the features to the shared folder and counts nulls there. An empty table gives no rows.

    Aggregates and array expressions run in the JVM in one ``groupBy``; only calculators of tier C are handed, as one
    array per series, to numpy. An entity's series has as many values as buckets, not as events.
    """

    identifier_col_name: str
    time_col_name: str
    excluded_cols_name: Sequence[str] | None = None
    feature_calculators: Sequence[str] | None = None
    drop_nulls: bool = True
    plain_names: bool = True

    def _calculators(self) -> list[str]:
        chosen = list(self.feature_calculators) if self.feature_calculators is not None else catalog.names()
        for c in chosen:
            if catalog.tier(c) is None:
                raise ValueError(f"Feature calculator {c} is not supported")
        return chosen

    def __call__(self, df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
        chosen, ident, time = self._calculators(), self.identifier_col_name, self.time_col_name
        out = list(self.excluded_cols_name or [])
        need_columns(df, [ident, time, *out])
        need_time(df, [time])
        kinds = [c for c in df.columns if c not in {ident, time, *out}]
        need_numeric(df, [*kinds, *out], "numerical")
        values = {k: F.when(~F.isnan(F.col(f"`{k}`").cast("double")), F.col(f"`{k}`").cast("double")) for k in kinds}
        narrow = df.select(F.col(ident), F.col(time).alias("_t"), *[v.alias(f"v{i}") for i, v in enumerate(values.values())], *[F.col(c).alias(f"x{i}") for i, c in enumerate(out)])
        arrays, numeric = [c for c in chosen if c in ARRAYS], [c for c in chosen if c in PARAMETERS]
        aggs, names = [], []
        for i, kind in enumerate(kinds):
            v = F.col(f"v{i}")
            for c in chosen:
                for name, agg in AGGREGATES.get(c, {}).items():
                    aggs.append(agg(v).alias(f"f{len(names)}"))
                    names.append((f"{kind}__{name}", f"f{len(names)}"))
            if arrays or numeric:
                pairs = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("_t", v.alias("v")))))
                aggs += [F.transform(pairs, lambda p: p["v"]).alias(f"a{i}"), *[b(v).alias(f"{k}{i}") for k, b in BASE.items()]]
        aggs += [F.min_by(f"x{i}", "_t").alias(f"x{i}") for i in range(len(out))]
        g = narrow.groupBy(ident).agg(*aggs, F.count("*").alias("_rows"))
        for i, kind in enumerate(kinds):
            if arrays:
                g = g.withColumn(f"d{i}", F.expr(f"zip_with(slice(a{i}, 2, greatest(size(a{i}) - 1, 0)), slice(a{i}, 1, greatest(size(a{i}) - 1, 0)), (p, q) -> p - q)"))
                filled = {"{a}": f"a{i}", "{d}": f"d{i}", "{n}": f"CAST(n{i} AS INT)", "{mean}": f"mean{i}", "{sd}": f"sd{i}", "{lo}": f"lo{i}", "{hi}": f"hi{i}"}
                more = []
                for c in arrays:
                    for name, text in ARRAYS[c].items():
                        for token, word in filled.items():
                            text = text.replace(token, word)
                        column = f"f{len(names)}"
                        more.append(f"CASE WHEN n{i} > 0 THEN CAST(({text}) AS DOUBLE) END AS {column}")
                        names.append((f"{kind}__{name}", column))
                g = g.selectExpr("*", *more)
            if numeric:
                g = g.withColumn(f"c{i}", _in_numpy(numeric)(F.col(f"a{i}")))
                for k, name in enumerate(label(c, **p) for c in numeric for p in PARAMETERS[c]):
                    names.append((f"{kind}__{name}", f"c{i}[{k}]"))
        wide = g.selectExpr(f"`{ident}`", *[f"CAST({c} AS DOUBLE) AS `{name}`" for name, c in names], *[f"x{i} AS `{c}`" for i, c in enumerate(out)])
        wide = clean_names(wide) if self.plain_names else wide
        if not self.drop_nulls:
            return wide
        wide.write.parquet(kept := shared_path(df.sparkSession, "caratteristiche"))  # computed once, for the nulls and for the result
        return drop_null_columns(df.sparkSession.read.parquet(kept), [ident, *out])


def _in_numpy(names: list[str]):
    """An Arrow function from the array of a series to the array of all values of the calculators; NaN becomes null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[None if v != v else v for v in evaluate(np.asarray(x if x is not None else [], float), names)] for x in b])

    return values

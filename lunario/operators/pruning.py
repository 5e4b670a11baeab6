"""Features that have something to do with a target: one test per feature, then control of false discoveries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.functions.stats import false_discovery, fisher, kendall, mann_whitney, smirnov
from lunario.types import need_columns, need_numeric


def _p_value(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: bool) -> tuple[str, float]:
    """(type of the feature, p-value) of weighted pairs."""
    levels = np.unique(x)
    if len(levels) == 1:
        return "constant", float("nan")
    two = len(levels) == 2
    if not classes:
        return ("binary", smirnov(y, (x == levels[1]).astype(float), w)) if two else ("real", kendall(x, y, w))
    best = 1.0
    for label in np.unique(y):
        own = (y == label).astype(float)
        if two:
            high = (x == levels[1]).astype(float)
            best = min(best, fisher(*(int((w * a * b).sum()) for a in (high, 1 - high) for b in (own, 1 - own))))
        else:
            best = min(best, mann_whitney(x, own, w))
    return "binary" if two else "real", best


@dataclass
class FeaturePruning:
    """(table of relevant features, relevance table) for a numeric target.

    Whole-number targets are classes (one against the rest, the least p-value counts), fractions are values. Two-level
    features: exact table test or distance of distributions; others: rank sums or rank correlation. A feature is
    relevant if its hypothesis falls at a false discovery rate of ``level`` under any dependence. Nulls are an error.

    (feature, value, target) are counted before anything is gathered, so a task holds a feature's distinct pairs, and
    only the p-values come to the driver.
    """

    identifier_col_name: str
    target_col_name: str
    level: float = 0.05

    def relevance(self, df: DataFrame) -> DataFrame:
        need_columns(df, [self.identifier_col_name, self.target_col_name])
        features = [c for c in df.columns if c not in (self.identifier_col_name, self.target_col_name)]
        need_numeric(df, [*features, self.target_col_name])
        quoted = [F.col(f"`{c}`").cast("double") for c in [*features, self.target_col_name]]
        bad = df.agg(*[F.count_if(c.isNull() | F.isnan(c)).alias(str(k)) for k, c in enumerate(quoted)]).first()
        if missing := [c for k, c in enumerate([*features, self.target_col_name]) if bad[k]]:
            raise ValueError(f"Columns {missing} of DataFrame must not contain NaN values")
        classes = not isinstance(df.schema[self.target_col_name].dataType, T.FloatType | T.DoubleType | T.DecimalType)
        flat = df.select(F.col(self.target_col_name).cast("double").alias("_y"), *[q.alias(c) for q, c in zip(quoted, features, strict=False)])
        pairs = flat.unpivot(["_y"], [F.col(f"`{c}`") for c in features], "feature", "_x").groupBy("feature", "_x", "_y").agg(F.count("*").alias("_w"))

        def test(pdf: pd.DataFrame) -> pd.DataFrame:
            kind, p = _p_value(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_w"].to_numpy().astype(float), classes)
            return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "type": [kind], "p_value": [p]})

        return pairs.groupBy("feature").applyInPandas(test, "feature string, type string, p_value double")

    def __call__(self, df: DataFrame, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
        table = self.relevance(df).toPandas().sort_values(["p_value", "feature"], na_position="last", ignore_index=True)
        tested = table["p_value"].notna().to_numpy()
        table["relevant"] = False
        table.loc[tested, "relevant"] = false_discovery(table.loc[tested, "p_value"].to_numpy(), self.level)
        rows = [(r.feature, r.type, None if r.p_value != r.p_value else float(r.p_value), bool(r.relevant)) for r in table.itertuples()]
        relevance = df.sparkSession.createDataFrame(rows, "feature string, type string, p_value double, relevant boolean")
        kept = [f"`{r[0]}`" for r in rows if r[3]]
        return df.select(self.identifier_col_name, self.target_col_name, *kept), relevance

"""Chains of steps, by hand or from a configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lunario.functions.predicates import AndGroup, Filter, OrGroup
from lunario.operators.aggregating import Aggregating, Aggregation, Pivot
from lunario.operators.bucketing import TimeBucketing
from lunario.operators.features import FeatureGenerating
from lunario.operators.filling import Filling

BUCKET = ("bucket_start", "bucket_end")


class Pipeline:
    """Steps applied one after the other; nothing runs before the result is used, but for what a step must know first."""

    def __init__(self, steps: Sequence):
        self.steps = list(steps)

    def __call__(self, df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
        for step in self.steps:
            df = step(df, spark)
        return df


def filter_from(config: dict) -> Filter | AndGroup | OrGroup:
    """``{col, op, value}``, ``{and: [...]}`` or ``{or: [...]}``, each with an optional ``name``."""
    for word, group in (("and", AndGroup), ("or", OrGroup)):
        if word in config:
            return group([filter_from(f) for f in config[word]], config.get("name"))
    return Filter(config["col"], config["op"], config["value"], config.get("name"))


def build(config: dict) -> Pipeline:
    """A pipeline from a plain dictionary: ``ids``, ``time``, ``bucket`` (size, granularity), ``aggregations``, ``fill``, ``features``."""
    bucketing = TimeBucketing(config["time"], config["bucket"]["size"], config["bucket"]["granularity"])
    aggregations = [
        Aggregation(
            a["col"], a["fn"], [filter_from(f) for f in a.get("filters", [])],
            Pivot(p["col"], "=", p.get("values"), p.get("name")) if (p := a.get("pivot")) else None, a.get("name"),
        ) for a in config["aggregations"]
    ]
    steps: list = [bucketing, Aggregating(config["ids"], list(BUCKET), aggregations)]
    if config.get("fill", True):
        steps.append(Filling(config["ids"], bucketing))
    if (wanted := config.get("features")) is not None:
        steps += [lambda df, _=None: df.drop(BUCKET[1]), FeatureGenerating(config["ids"][0], BUCKET[0], feature_calculators=wanted or None)]
    return Pipeline(steps)

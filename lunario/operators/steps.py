"""What all steps have in common: check the input, plan, tidy the result."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession


class Step(ABC):
    """A table-to-table step: ``preprocess`` checks and readies the input, ``process`` plans, ``postprocess`` tidies the result.

    A step of one's own gives ``process`` and whichever of the others it needs. The session may be left out.
    """

    def preprocess(self, df: DataFrame) -> DataFrame:
        return df

    @abstractmethod
    def process(self, df: DataFrame) -> DataFrame: ...

    def postprocess(self, df: DataFrame) -> DataFrame:
        return df

    def __call__(self, df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
        return self.postprocess(self.process(self.preprocess(df)))


def whole_positive(value: object, what: str) -> int:
    """A positive whole number, not something that merely converts to one."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{what} must be a positive integer")
    return value

"""Missing buckets of every entity's series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.functions.cleaning import wall
from lunario.operators.bucketing import TimeBucketing
from lunario.operators.steps import Step
from lunario.types import NUMERIC, need_columns, need_rows, need_time


@dataclass
class Filling(Step):
    """Every bucket from an entity's first to its last, in the grid of its own first bucket; new and null numbers are 0.

    Columns that are not numbers stay null in new buckets. Identifiers are never filled. The sequence of an entity is
    one array row, exploded, and joined to the series on (identifiers, start).
    """

    identifier_cols_name: Sequence[str]
    time_bucket_step: TimeBucketing
    columns: tuple[str, str] = ("bucket_start", "bucket_end")
    fill_value: float = 0

    def preprocess(self, df: DataFrame) -> DataFrame:
        """All checks; an empty table is an error."""
        need_columns(df, [*self.identifier_cols_name, *self.columns])
        need_time(df, self.columns)
        need_rows(df)
        return df

    def process(self, df: DataFrame) -> DataFrame:
        ids, (start, end) = list(self.identifier_cols_name), self.columns
        g = self.time_bucket_step.grid
        span = df.groupBy(*ids).agg(F.min(wall(F.col(start))).alias("_o"), F.max(wall(F.col(start))).alias("_l"))
        k = F.explode(F.sequence(F.lit(0).cast("bigint"), g.number(F.col("_l"), F.col("_o")))).alias("_k")
        at = g.add(F.col("_o"), F.col("_k"))
        keys = [f"_i{n}" for n in range(len(ids))]
        rest = [c for c in df.columns if c not in {*ids, start, end}]
        grid = span.where("_o is not null").select(*[F.col(c).alias(i) for c, i in zip(ids, keys, strict=True)], "_o", k)
        grid = grid.select(*keys, at.alias("_s"), (g.add(at, 1) - F.expr("interval 1 second")).cast("timestamp_ntz").alias("_e"))
        series = df.select(*[F.col(c).alias(f"_j{n}") for n, c in enumerate(ids)], wall(F.col(start)).alias("_at"), *[F.col(f"`{c}`").alias(f"_v{n}") for n, c in enumerate(rest)])
        on = F.col("_s") == F.col("_at")
        for n, i in enumerate(keys):
            on = on & F.col(i).eqNullSafe(F.col(f"_j{n}"))
        values = []
        for n, c in enumerate(rest):
            v, t = F.col(f"_v{n}"), df.schema[c].dataType
            values.append((F.coalesce(v, F.lit(self.fill_value).cast(t)) if isinstance(t, NUMERIC) else v).alias(c))
        return grid.join(series, on, "left").select(*[F.col(i).alias(c) for c, i in zip(ids, keys, strict=True)], F.col("_s").alias(start), F.col("_e").alias(end), *values)

"""Calendar buckets by arithmetic: no bucket table, no range join."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lunario.functions.cleaning import from_micros, micros, wall, wall_literal
from lunario.operators.steps import Step, whole_positive
from lunario.types import need_columns, need_rows, need_time

#: Granularity by first letter: the unit that is counted and how many make one.
UNITS = {"h": ("HOUR", 1), "d": ("DAY", 1), "w": ("DAY", 7), "m": ("MONTH", 1), "y": ("MONTH", 12)}
#: Microseconds in a unit of fixed length, and of the first start of one after 1970-01-01 (weeks start on Monday).
HOUR_US = 3_600_000_000
FIXED = {"h": (HOUR_US, 0), "d": (24 * HOUR_US, 0), "w": (168 * HOUR_US, 96 * HOUR_US)}
NAMES = {"h": ("h", "hour", "hours"), "d": ("d", "day", "days"), "w": ("w", "week", "weeks"), "m": ("m", "month", "months"), "y": ("y", "year", "years")}


def granularity(text: str) -> str:
    letter = next((k for k, names in NAMES.items() if text in names), None)
    if letter is None:
        raise ValueError(f"Granularity {text} is not supported")
    return letter


@dataclass(frozen=True)
class Grid:
    """A regular calendar grid: buckets of ``size`` units from an origin on."""

    letter: str
    size: int

    def floor(self, time: Column) -> Column:
        """The start of the hour, day, week, month or year of a time. No step passes through the session's zone."""
        if self.letter in FIXED:
            length, first = FIXED[self.letter]
            us = micros(time)
            return from_micros(us - F.pmod(us - F.lit(first), F.lit(length)))
        return F.trunc(F.to_date(wall(time)), {"m": "month", "y": "year"}[self.letter]).cast("timestamp_ntz")

    def add(self, start: Column, buckets: Column | int) -> Column:
        unit, n = UNITS[self.letter]
        count = (F.lit(buckets) if isinstance(buckets, int) else buckets) * (n * self.size)
        return F.timestamp_add(unit, count.cast("int"), start).cast("timestamp_ntz")

    def number(self, time: Column, origin: Column) -> Column:
        """Buckets between the origin and a time, rounded down; negative before the origin."""
        unit, n = UNITS[self.letter]
        if unit == "MONTH":
            months = (F.year(time) - F.year(origin)) * 12 + F.month(time) - F.month(origin)
            return F.floor(months / F.lit(n * self.size)).cast("bigint")
        length = F.lit(FIXED[self.letter][0] * self.size)
        past = micros(time) - micros(origin)
        return ((past - F.pmod(past, length)) / length).cast("bigint")  # a whole number, so the division is exact enough


@dataclass
class TimeBucketing(Step):
    """Adds ``bucket_start`` and ``bucket_end`` (inclusive: one second before the next start) to every row with a time.

    The grid starts at the least time, rounded down to the hour, day, Monday, month or year; ``origin`` fixes it, so
    that tables bucketed apart share one grid. Rows without time are dropped. All on wall clock, so zones and
    daylight saving change nothing. One aggregate for the least time, then a projection: nothing is shuffled.
    """

    time_col_name: str
    time_bucket_size: int
    time_bucket_granularity: str
    origin: dt.datetime | None = None
    columns: tuple[str, str] = ("bucket_start", "bucket_end")

    def __post_init__(self) -> None:
        whole_positive(self.time_bucket_size, "time_bucket_size")
        granularity(self.time_bucket_granularity)

    @property
    def grid(self) -> Grid:
        return Grid(granularity(self.time_bucket_granularity), self.time_bucket_size)

    def extent(self, df: DataFrame) -> tuple[dt.datetime, dt.datetime]:
        """(floor of the least time, greatest time), in one pass."""
        t = wall(F.col(self.time_col_name))
        first, last = df.agg(self.grid.floor(F.min(t)), F.max(t)).first()
        if first is None:
            raise ValueError("Empty DataFrame")
        return first, last

    def timeline(self, df: DataFrame) -> DataFrame:
        """All buckets of the grid between the least and the greatest time, made on the executors."""
        first, last = self.extent(df)
        o, g = wall_literal(self.origin or first), self.grid
        n = g.number(wall_literal(last), o)
        k = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("k"))
        return k.select(*self._edges(g.add(o, F.col("k"))))

    def _edges(self, start: Column) -> list[Column]:
        end = (self.grid.add(start, 1) - F.expr("interval 1 second")).cast("timestamp_ntz")
        return [start.alias(self.columns[0]), end.alias(self.columns[1])]

    def preprocess(self, df: DataFrame) -> DataFrame:
        if self.time_col_name not in df.columns:
            need_rows(df)
            raise ValueError(f"Column {self.time_col_name} is not present")
        need_time(df, [self.time_col_name])
        return df

    def process(self, df: DataFrame) -> DataFrame:
        t = wall(F.col(self.time_col_name))
        o = wall_literal(self.origin or self.extent(df)[0])
        start = self.grid.add(o, self.grid.number(t, o))
        return df.where(F.col(self.time_col_name).isNotNull()).select("*", *self._edges(start))


def tag_windows(df: DataFrame, columns: tuple[str, str] = ("bucket_start", "bucket_end"), window: str = "bucket") -> DataFrame:
    """The two edges as one struct of ``start`` and ``end``."""
    need_columns(df, columns)
    return df.withColumn(window, F.struct(F.col(columns[0]).alias("start"), F.col(columns[1]).alias("end"))).drop(*columns)

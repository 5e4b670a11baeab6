"""Many filtered and pivoted aggregates over one key in a single pass."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lunario.functions.naming import aggregate_name
from lunario.functions.predicates import Filter, all_of, labels
from lunario.operators.steps import Step
from lunario.types import need_columns, need_numeric, need_rows, need_time

FUNCTIONS = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last}


@dataclass(frozen=True)
class Pivot:
    """One column per value of ``col_name``; all its distinct values where none are given. ``operator`` is kept for configs and always means equality."""

    col_name: str
    operator: str = "="
    value: Sequence | None = None
    name: str | None = None


@dataclass(frozen=True)
class Aggregation:
    """One function of one numeric column, over the rows that satisfy all filters, maybe once per pivot value."""

    numerical_col_name: str
    agg_function: str
    filters: Sequence = field(default_factory=list)
    pivot: Pivot | None = None
    new_col_name: str | None = None

    def __post_init__(self) -> None:
        if self.agg_function not in FUNCTIONS:
            raise ValueError("Aggregation function not allowed")

    def check(self, df: DataFrame) -> None:
        need_numeric(df, [self.numerical_col_name])
        for f in self.filters:
            f.check(df)
        if self.pivot:
            need_columns(df, [self.pivot.col_name])
        if self.new_col_name in df.columns:
            raise ValueError(f"Column {self.new_col_name} is already a column")

    def names(self, values: Sequence | None = None) -> list[str]:
        """Output names, in order."""
        text = labels(self.filters)
        if not self.pivot:
            return [aggregate_name(self.agg_function, self.numerical_col_name, text, None, self.new_col_name)]
        return [aggregate_name(self.agg_function, self.numerical_col_name, text, (self.pivot.col_name, v, self.pivot.name), self.new_col_name) for v in values or self.pivot.value or ["?"]]

    def columns(self, values: Sequence | None, order: Column | None) -> list[Column]:
        """Aggregates with their names. A key whose rows are all filtered out stays, with null (count: 0).

        A pivot counts null, not 0, where a key has no row of the value, as a pivot by Spark does.
        """
        where = all_of(self.filters)
        cells = [None] if not self.pivot else [F.col(self.pivot.col_name).eqNullSafe(F.lit(v)) for v in values]
        out = []
        for cell, name in zip(cells, self.names(values), strict=True):
            p = where if cell is None else cell if where is None else where & cell
            out.append(self._one(p, cell is not None, order).alias(name))
        return out

    def _one(self, p: Column | None, pivoted: bool, order: Column | None) -> Column:
        v, fn = F.col(self.numerical_col_name), self.agg_function
        x = v if p is None else F.when(p, v)
        if fn in ("first", "last"):
            if order is None:
                if p is None:
                    return FUNCTIONS[fn](v)
                picked = FUNCTIONS[fn](F.when(p, F.struct(v.alias("v"))), ignorenulls=True)
                return picked["v"]
            pick = F.min_by if fn == "first" else F.max_by
            return pick(F.struct(v.alias("v")), F.when(p, order) if p is not None else order)["v"]
        if fn == "count" and pivoted:
            return F.when(F.count(F.when(p, F.lit(1))) > 0, F.count(x))
        return FUNCTIONS[fn](x)


@dataclass
class Aggregating(Step):
    """One row per (identifiers, bucket) and one column per aggregation, all from one scan and one shuffle.

    Null keys are keys. Two outputs of one name are an error. ``order_by`` makes ``first`` and ``last`` deterministic.
    Values of a pivot without values are read once per call and sorted. The result is not sorted unless ``sort``.
    """

    identifier_cols_name: Sequence[str]
    time_bucket_cols_name: Sequence[str]
    aggregations: Sequence[Aggregation]
    order_by: str | None = None
    sort: bool = False
    most_pivot_values: int = 10_000

    def __post_init__(self) -> None:
        for what in ("identifier_cols_name", "time_bucket_cols_name", "aggregations"):
            if not getattr(self, what):
                raise ValueError(f"{what} needs at least one entry")

    def _values(self, df: DataFrame) -> dict[str, list]:
        """Distinct values of the columns that are pivoted without values, a job a column."""
        open_ = sorted({a.pivot.col_name for a in self.aggregations if a.pivot and not a.pivot.value})
        if not open_:
            return {}
        values = {}
        for c in open_:
            found = [r[0] for r in df.select(c).distinct().limit(self.most_pivot_values + 1).collect()]  # never more than that are gathered
            if len(found) > self.most_pivot_values:
                raise ValueError(f"Column {c} has too many values; a pivot has at most {self.most_pivot_values}")
            values[c] = sorted(v for v in found if v is not None) + ([None] if None in found else [])
        return values

    def preprocess(self, df: DataFrame) -> DataFrame:
        """All checks; an empty table is an error."""
        keys = [*self.identifier_cols_name, *self.time_bucket_cols_name]
        need_columns(df, keys)
        need_time(df, self.time_bucket_cols_name)
        for a in self.aggregations:
            a.check(df)
        need_rows(df)
        return df

    def process(self, df: DataFrame) -> DataFrame:
        keys = [*self.identifier_cols_name, *self.time_bucket_cols_name]
        found = self._values(df)
        values = [None if not a.pivot else list(a.pivot.value or found[a.pivot.col_name]) for a in self.aggregations]
        names = [n for a, v in zip(self.aggregations, values, strict=True) for n in a.names(v)]
        if twice := [n for n, k in Counter([*keys, *names]).items() if k > 1]:
            raise ValueError(f"Output names {twice} occur more than once")
        order = F.col(self.order_by) if self.order_by else None
        columns = [c for a, v in zip(self.aggregations, values, strict=True) for c in a.columns(v, order)]
        return df.groupBy(*keys).agg(*columns)

    def postprocess(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*self.identifier_cols_name, *self.time_bucket_cols_name) if self.sort else df

    def simulate_renaming(self) -> list[tuple[str, str]]:
        """(plain aggregate, output name) of every column that is known without data."""
        return [(f"{a.agg_function}({a.numerical_col_name})", n) for a in self.aggregations for n in a.names()]


__all__ = ["Aggregating", "Aggregation", "Filter", "Pivot"]

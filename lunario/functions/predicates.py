"""Filters as data: comparisons and their groups, checked against a schema and turned into one column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.types import FRACTIONAL, INTEGRAL, kind_of

Scalar = str | int | float | bool
COMPARISONS = {
    "=": Column.__eq__, "==": Column.__eq__, "!=": Column.__ne__,
    "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
}
ORDERINGS = {"<", "<=", ">", ">="}
MEMBERSHIPS = {"in", "notin", "not in"}


def operator_named(text: str) -> str:
    """The operator of that spelling; ``==`` is ``=`` and ``not in`` is ``notin``."""
    if text not in COMPARISONS and text not in MEMBERSHIPS:
        raise ValueError("Operator not allowed")
    return {"==": "=", "not in": "notin"}.get(text, text)


@dataclass(frozen=True)
class Filter:
    """``column operator value``. Rows whose column is null satisfy no filter, ``!=`` and ``notin`` included."""

    col_name: str
    operator: str
    value: Scalar | Sequence[Scalar]
    name: str | None = None

    def __post_init__(self) -> None:
        op, many = operator_named(self.operator), isinstance(self.value, list | tuple)
        number = isinstance(self.value, int | float) and not isinstance(self.value, bool)
        if op in ORDERINGS and not number:
            raise ValueError(f"Operator {op} needs a number as value")
        if op in MEMBERSHIPS and not many:
            raise ValueError(f"Operator {op} needs a list as value")
        if op not in MEMBERSHIPS and many:
            raise ValueError(f"Operator {op} needs a single value")
        if many and len({type(v) for v in self.value}) > 1:
            raise ValueError("The values of a list must have one type")

    def check(self, df: DataFrame) -> None:
        """The column must exist and have a type that goes with the value."""
        t = kind_of(df, self.col_name)
        values = self.value if isinstance(self.value, list | tuple) else [self.value]
        fits = {
            bool: lambda: isinstance(t, T.BooleanType),
            int: lambda: isinstance(t, (*INTEGRAL, *FRACTIONAL, T.DecimalType)),
            float: lambda: isinstance(t, (*FRACTIONAL, T.DecimalType)),
            str: lambda: isinstance(t, T.StringType),
        }
        if any(not fits[type(v)]() for v in values):
            raise ValueError(f"Mismatch types between {self.col_name} column ({t.simpleString()}) and value {self.value!r}")

    def column(self) -> Column:
        op, c = operator_named(self.operator), F.col(self.col_name)
        if op in MEMBERSHIPS:
            return c.isin(list(self.value)) if op == "in" else ~c.isin(list(self.value))
        return COMPARISONS[op](c, F.lit(self.value))

    def label(self) -> str:
        if self.name is not None:
            return self.name
        op = operator_named(self.operator)
        if op in MEMBERSHIPS:  # both directions read alike; a clash of output names is reported
            return f"{self.col_name}[{'_'.join(str(v) for v in self.value)}]"
        return f"{self.col_name}{op}{self.value}"


@dataclass(frozen=True)
class _Group:
    filters: Sequence[Filter | _Group]
    name: str | None = None

    def __post_init__(self) -> None:
        if not self.filters:
            raise ValueError("A group of filters needs at least one filter")

    def check(self, df: DataFrame) -> None:
        for f in self.filters:
            f.check(df)

    def column(self) -> Column:
        return reduce(self._join, [f.column() for f in self.filters])

    def label(self) -> str:
        return self.name if self.name is not None else "(" + self._sign.join(f.label() for f in self.filters) + ")"


@dataclass(frozen=True)
class AndGroup(_Group):
    """All filters hold."""

    _join, _sign = staticmethod(and_), "&"


@dataclass(frozen=True)
class OrGroup(_Group):
    """At least one filter holds."""

    _join, _sign = staticmethod(or_), "|"


def all_of(filters: Sequence[Filter | _Group]) -> Column | None:
    """The conjunction of a list of filters; none for an empty list."""
    return reduce(and_, [f.column() for f in filters]) if filters else None


def labels(filters: Sequence[Filter | _Group]) -> str:
    return "&".join(f.label() for f in filters)

"""Column functions for values as they are delivered: names, amounts, times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank at the ends of and inside a text.
BLANK = r"[\s\u0085   -​    　﻿]"
CENTS_TYPE = "decimal(38,0)"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def strip(text: Column) -> Column:
    """Text without blanks of any script at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def canonical_name(text: Column) -> Column:
    """One spelling of a name: no outer blanks, lower case, runs of blanks, ``_`` and ``-`` as one ``_``.

    Null stays null; a text of blanks only gives null.
    """
    name = F.regexp_replace(F.lower(strip(text)), rf"(?:{BLANK}|[_-])+", "_")
    plain = text.rlike("^[a-z0-9]+(?:_[a-z0-9]+){0,5}$")  # as most are
    return F.when(plain, text).otherwise(F.nullif(name, F.lit("")))


def number_or_null(value: Column) -> Column:
    """Null for NaN and infinities as well, so that sums stay numbers."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def cents(value: Column) -> Column:
    """An amount as a whole number of cents, so that sums are exact and independent of order. NaN gives null."""
    v = number_or_null(value) * 100
    whole = F.floor(F.abs(v))  # halves away from 0, as ``round`` has it, without its decimals
    up = whole + F.when(F.abs(v) - whole >= 0.5, 1).otherwise(0)
    return F.when(v < 0, -up).otherwise(F.when(v.isNotNull(), up)).cast("bigint")


def wall(time: Column) -> Column:
    """A date or time as wall clock without zone."""
    return time.cast("timestamp_ntz")


def wall_literal(time: dt.datetime) -> Column:
    """A wall-clock constant; a datetime as such would pass through the session's zone."""
    return F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(time: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock time, whatever the session's zone."""
    t = wall(time)  # field by field: a difference of times passes through the session's zone
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    day = F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000
    return day + seconds.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def from_micros(us: Column) -> Column:
    """The wall-clock time of :func:`micros`."""
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH)).cast("timestamp_ntz")

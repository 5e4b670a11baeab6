"""Totals over trailing periods per entity and calendar day, by a two-stack queue over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.functions.cleaning import cents, wall

#: Days handed on in one go; bounds a worker's memory.
CHUNK_DAYS = 400_000


@dataclass(frozen=True)
class Monoid:
    """An associative operation with its identity; no inverse is needed."""

    name: str
    of: np.ufunc
    identity: int


SUM = Monoid("sum", np.add, 0)
MAX = Monoid("max", np.maximum, np.iinfo(np.int64).min)
MIN = Monoid("min", np.minimum, np.iinfo(np.int64).max)


def two_stack(x: np.ndarray, width: int, monoid: Monoid) -> np.ndarray:
    """The aggregate of each element and the ``width - 1`` before it.

    A queue of two stacks: arrivals are pushed onto the back stack, which keeps one running aggregate; when the front
    stack is used up, the back stack is turned over, which gives the front stack the aggregates of every suffix. A
    queue of constant length turns over every ``width`` arrivals, so whole turns are laid out as rows of a matrix:
    running aggregates along a row are the back stack, those from the row's end the front stack, and each window is
    the front of one turn combined with the back of the next. Two operations an element, none undone.
    """
    n = len(x)
    if width == 1 or n == 0:
        return x.copy()
    turns = -(-n // width)
    rows = np.full(turns * width, monoid.identity, np.int64)
    rows[:n] = x
    rows = rows.reshape(turns, width)
    back = monoid.of.accumulate(rows, axis=1).ravel()
    front = np.ascontiguousarray(monoid.of.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    out = back[:n].copy()  # windows that end a turn lie in the back stack alone; so do the first ones
    at = np.arange(width, n)
    at = at[(at + 1) % width != 0]
    out[at] = monoid.of(front[at - width + 1], back[at])
    return out


def _spread(ids: np.ndarray, days: np.ndarray, columns: list[tuple[np.ndarray, Monoid]], pad: int):
    """Rows of whole entities, sorted by day, as dense series with ``pad`` empty days before each entity."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    last = np.r_[first[1:], len(ids)] - 1
    span = days[last] - days[first] + 1
    begin = np.cumsum(span + pad) - span
    n = int(begin[-1] + span[-1])
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
    place = begin[owner] + days - days[first][owner]
    dense = []
    for values, monoid in columns:
        x = np.full(n, monoid.identity, np.int64)
        x[place] = values
        dense.append(x)
    keep = np.repeat(begin - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(int(span.sum()))
    who = np.repeat(ids[first], span)
    day = np.repeat(days[first] - begin, span) + keep
    return dense, keep, who, day


def _rolled(widths: Sequence[int], monoids: list[Monoid], names: list[str], emit: Callable | None, schema: pa.Schema):
    pad = max(widths) - 1

    def part(ids: np.ndarray, days: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        dense, keep, who, day = _spread(ids, days, list(zip(values, monoids, strict=True)), pad)
        out = {"id": who, "day": day}
        for name, x, monoid in zip(names, dense, monoids, strict=True):
            for w in widths:
                out[f"{name}_{w}"] = two_stack(x, w, monoid)[keep]
        if emit is not None:
            chosen = emit(out)
            out = {k: v[chosen] for k, v in out.items()}
        if len(out["id"]):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name].astype(f.type.to_pandas_dtype()), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            ids, days = cols[0], cols[1]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            end = int(starts[-1])  # the last entity may go on in the next batch
            rest = [c[end:] for c in cols]
            yield from pieces(cols, starts[:-1], end)
        if rest is not None:
            yield from part(rest[0], rest[1], rest[2:])

    def pieces(cols: list[np.ndarray], starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        if not len(starts):
            return
        lasts = np.r_[starts[1:], end] - 1
        filled = np.cumsum(cols[1][lasts] - cols[1][starts] + 1 + pad)
        a = 0
        while a < len(starts):
            base = filled[a - 1] if a else 0
            z = max(int(np.searchsorted(filled, base + CHUNK_DAYS, "right")), a + 1)
            lo, hi = int(starts[a]), int(starts[z]) if z < len(starts) else end
            yield from part(cols[0][lo:hi], cols[1][lo:hi], [c[lo:hi] for c in cols[2:]])
            a = z

    return run


def daily(events: DataFrame, entity: str, time: str, amount: str, event_id: str | None = None) -> DataFrame:
    """(id, day, n, cents, most, least) of each entity and day with an event; ``day`` counts from 1970-01-01.

    Events without entity or time or with an amount that is null or not a finite number do not count. With
    ``event_id``, rows of one id count once, with the least of each field where they differ; rows without id count
    each. Amounts are exact cents.
    """
    e = events.select(
        *([F.col(event_id).alias("_e")] if event_id else []),
        F.col(entity).cast("bigint").alias("id"),
        F.unix_date(F.to_date(wall(F.col(time)))).alias("day"),
        cents(F.col(amount)).alias("c"),
    ).where("id is not null and day is not null and c is not null")
    if event_id:
        e = e.withColumn("_row", F.when(F.col("_e").isNull(), F.monotonically_increasing_id()))
        e = e.groupBy("_e", "_row").agg(F.min("id").alias("id"), F.min("day").alias("day"), F.min("c").alias("c"))
    return e.groupBy("id", "day").agg(F.count("*").alias("n"), F.sum("c").alias("cents"), F.max("c").alias("most"), F.min("c").alias("least"))


def rolling_totals(
    events: DataFrame,
    *,
    entity: str,
    time: str,
    amount: str,
    event_id: str | None = None,
    widths: Sequence[int] = (7, 30),
    measures: Sequence[str] = ("n", "cents", "most"),
    emit: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """One row per entity and calendar day from its first to its last day with an event.

    For each width w: ``n_w`` events, ``cents_w`` their total, ``most_w`` and ``least_w`` the greatest and least
    amount (null without events in the window). ``measures`` narrows these; ``emit`` gets the columns of a piece as
    arrays and returns which rows to hand on. Days before an entity's first day count as empty. Amounts are cents.
    See :func:`daily` for nulls, NaN and repeats. No events give no rows.

    Scale: events are combined to days before entities meet, so an entity with a third of all events arrives as no
    more rows than there are days. Partitions are sorted by entity and day and read as a stream; a worker holds one
    entity's days and a piece of bounded length.
    """
    monoids = {"n": SUM, "cents": SUM, "most": MAX, "least": MIN}
    order = [m for m in ("n", "cents", "most", "least") if m in measures]
    by_day = daily(events, entity, time, amount, event_id).select("id", "day", *order)
    schema = pa.schema([("id", pa.int64()), ("day", pa.int32()), *[(f"{m}_{w}", pa.int64()) for m in order for w in widths]])
    ddl = "id bigint, day int, " + ", ".join(f"{m}_{w} bigint" for m in order for w in widths)
    rolled = (
        by_day.repartition("id").sortWithinPartitions("id", "day")
        .mapInArrow(_rolled(tuple(widths), [monoids[m] for m in order], order, emit, schema), ddl)
    )
    out = [F.col("id").alias(entity), F.date_from_unix_date("day").alias("giorno")]
    for m in order:
        for w in widths:
            c = F.col(f"{m}_{w}")
            out.append((F.when(c != monoids[m].identity, c) if m in ("most", "least") else c).alias(f"{m}_{w}"))
    return rolled.select(*out)

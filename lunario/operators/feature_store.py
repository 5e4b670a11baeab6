"""One row of features per entity from time-bucketed partial aggregates that are kept and refreshed by bucket."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.functions.cleaning import cents, wall, wall_literal

#: The bucket of events without a time.
NO_TIME = "senza-data"


@dataclass
class FeatureStore:
    """Partial aggregates by (bucket, entity, type) below ``path``, a folder that all executors share.

    ``types``: name of a type column -> expression; an event's type is the tuple of these. ``amount`` is summed in
    whole cents; null, NaN and infinite amounts count as events but add nothing. ``event_id``: repeated deliveries of
    one id and type within a bucket count once (with the least of each other field if they differ); events without id
    count each.
    Events without entity belong to no row. Events without time have a bucket of their own and no date. Null types are
    a type of their own and take part in the totals over all types only.

    Buckets are calendar months; at most some thousands, so their list may be read by the driver.

    Scale: repeats are combined by id before the shuffle by entity; partials are shuffled once, by entity, where an
    entity has at most as many rows as buckets times types. A refresh reads the columns of the events once for the
    fingerprints, and again only the months that have changed.
    """

    path: str
    entity: str
    time: str
    amount: str
    types: dict[str, Column]
    event_id: str | None = None
    bucket: str = "month"
    _columns: list[str] = field(default_factory=lambda: ["n", "ultimo", "centesimi"], repr=False)

    def _events(self, events: DataFrame) -> DataFrame:
        t = wall(F.col(self.time))
        return events.select(
            *([F.col(self.event_id).alias("_e")] if self.event_id else []),
            F.col(self.entity).alias("entita"),
            *[c.alias(name) for name, c in self.types.items()],
            t.alias("t"),
            cents(F.col(self.amount)).alias("c"),
            _month(t).alias("_b"),
        ).where("entita is not null")

    def _within(self, events: DataFrame, buckets: Sequence[str]) -> DataFrame:
        """The events of some buckets, by conditions on the time column as it is stored, which a scan can use to skip data."""
        kind, at = events.schema[self.time].dataType, F.col(self.time)
        first = lambda b, months: F.timestamp_add("MONTH", F.lit(months), wall_literal(dt.datetime(int(b[:-3]), int(b[-2:]), 1))).cast(kind)
        spans: list[list] = []  # months in a row make one span
        for b in sorted(b for b in buckets if b != NO_TIME):
            if spans and _months(b) == _months(spans[-1][0]) + spans[-1][1]:
                spans[-1][1] += 1
            else:
                spans.append([b, 1])
        terms = [(at >= first(b, 0)) & (at < first(b, n)) for b, n in spans] + ([at.isNull()] if NO_TIME in buckets else [])
        return events.where(reduce(Column.__or__, terms, F.lit(False)))

    def _once(self, e: DataFrame) -> DataFrame:
        if not self.event_id:
            return e
        e = e.withColumn("_row", F.when(F.col("_e").isNull(), F.monotonically_increasing_id()))
        keys = ["_e", "_row", "_b", *self.types]
        return e.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("entita", "t", "c")])

    def fingerprints(self, events: DataFrame) -> DataFrame:
        """(secchio, righe, impronta): what a bucket's rows are, whatever their order; over all columns of ``events``."""
        rows = events.where(F.col(self.entity).isNotNull()).select(_month(wall(F.col(self.time))).alias("_b"), F.xxhash64(*[F.col(f"`{c}`") for c in events.columns]).alias("h"))
        sums = rows.groupBy("_b").agg(F.count("*").alias("righe"), F.sum(F.pmod("h", F.lit(2**31 - 1))).alias("impronta"))
        return sums.select(_bucket(F.col("_b")).alias("secchio"), "righe", "impronta")

    def _kept(self, spark: SparkSession) -> dict[str, tuple]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/impronte")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        return {r["secchio"]: (r["righe"], r["impronta"]) for r in spark.read.parquet(f"{self.path}/impronte").collect()}

    def refresh(self, events: DataFrame) -> list[str]:
        """Bring the partials up to date with ``events``; returns the buckets that were computed again.

        Only buckets whose fingerprint differs are read and rewritten. Partials are written before fingerprints: a run
        that breaks off leaves buckets that the next run computes again.
        """
        spark = events.sparkSession
        now = {r["secchio"]: (r["righe"], r["impronta"]) for r in self.fingerprints(events).collect()}
        kept = self._kept(spark)
        changed = sorted(b for b in now.keys() | kept.keys() if now.get(b) != kept.get(b))
        if changed or not kept:
            todo = self._events(self._within(events, changed) if kept else events)
            gone = [b for b in changed if b not in now]
            parts = self._partials(todo)
            if gone:  # an empty bucket is written as one row without entity, which no merge counts
                parts = parts.unionByName(spark.createDataFrame([(b,) for b in gone], "secchio string"), allowMissingColumns=True)
            parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("secchio").parquet(f"{self.path}/parziali")
            rows = [(b, n, h) for b, (n, h) in now.items()]
            spark.createDataFrame(rows, "secchio string, righe bigint, impronta bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/impronte")
        return changed

    def _partials(self, e: DataFrame) -> DataFrame:
        sums = self._once(e).groupBy("_b", "entita", *self.types).agg(F.count("*").alias("n"), F.max("t").alias("ultimo"), F.sum("c").alias("centesimi"))
        return sums.select(_bucket(F.col("_b")).alias("secchio"), "entita", *self.types, *self._columns)

    def partials(self, spark: SparkSession) -> DataFrame:
        """All kept partial aggregates."""
        return spark.read.parquet(f"{self.path}/parziali").where("entita is not null").withColumn("secchio", F.col("secchio").cast("string"))

    def merged(self, events: DataFrame, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """(entita, types, n, ultimo, centesimi) over ``since <= time < until``.

        Whole buckets come from the partials; only the events of the months in which ``since`` or ``until`` lies are
        read again. Without bounds all buckets count, that without time included.
        """
        spark = events.sparkSession
        p = self.partials(spark)
        if since or until:
            p = p.where(F.col("secchio") != NO_TIME)
        edges = set()
        if since:
            whole = since == dt.datetime(since.year, since.month, 1)
            edge = f"{since:%Y-%m}"
            edges |= set() if whole else {edge}
            p = p.where((F.col("secchio") >= edge) if whole else (F.col("secchio") > edge))
        if until:
            edge = f"{until:%Y-%m}"
            edges |= set() if until == dt.datetime(until.year, until.month, 1) else {edge}
            p = p.where(F.col("secchio") < edge)
        columns = ["entita", *self.types, *self._columns]
        p = p.select(*columns)
        if edges:
            e = self._events(self._within(events, sorted(edges)))
            e = e.where(F.col("t") >= wall_literal(since)) if since else e
            e = e.where(F.col("t") < wall_literal(until)) if until else e
            p = p.unionByName(self._partials(e).select(*columns))
        # By entity, so that what follows by entity needs no further shuffle.
        return p.repartition("entita").groupBy("entita", *self.types).agg(F.sum("n").alias("n"), F.max("ultimo").alias("ultimo"), F.sum("centesimi").alias("centesimi"))

    def feature_table(self, merged: DataFrame, kinds: Sequence[tuple[str, tuple]]) -> DataFrame:
        """One row per entity: for each kind (name, values of the types) ``{name}__n``, ``__ultimo`` (date), ``__totale``.

        ``kinds`` is the documented list of types that get columns; their number bounds the width. Kinds without an
        event have 0, null and 0. ``n``, ``ultimo`` and ``totale`` are over all events of the entity, of whatever type.

        An entity's merged rows (one per type at most) are spread over one array by position, from which the columns
        are taken. The rows come by entity from :meth:`merged`, so nothing is shuffled.
        """
        key = F.concat_ws("\u0001", *[F.coalesce(F.col(t).cast("string"), F.lit("\u0002")) for t in self.types])
        number = {"\u0001".join(str(v).lower() if isinstance(v, bool) else str(v) for v in values): k for k, (_, values) in enumerate(kinds)}
        lookup = merged.sparkSession.createDataFrame(list(number.items()), "_key string, _k int")
        m = merged.withColumn("_key", key).join(F.broadcast(lookup), "_key", "left")  # as many rows as kinds
        every = len(kinds)  # the place of the totals over all types
        places = F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(every))).otherwise(F.array(F.col("_k"), F.lit(every)))).alias("_k")
        cells = m.select("entita", places, "n", F.unix_date(F.to_date("ultimo")).alias("u"), F.col("centesimi").alias("c"))
        wide = cells.groupBy("entita").pivot("_k", list(range(every + 1))).agg(F.sum("n").alias("n"), F.max("u").alias("u"), F.sum("c").alias("c"))
        of = lambda k, name, total: [f"coalesce(`{k}_n`, 0L) AS `{name}n`", f"date_from_unix_date(`{k}_u`) AS `{name}ultimo`", f"coalesce(`{k}_c`, 0L) / 100 AS `{name}{total}`"]
        out = [f"entita AS `{self.entity}`", *of(every, "", "totale")]
        for k, (name, _) in enumerate(kinds):
            out += of(k, f"{name}__", "totale")
        return wide.selectExpr(*out)


def _month(t: Column) -> Column:
    """Months since the year 0, null without a time."""
    return F.year(t) * 12 + F.month(t) - 1


def _bucket(month: Column) -> Column:
    """The name of a month, as ``2024-03``."""
    name = F.concat(F.lpad(F.floor(month / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((month % 12 + 1).cast("string"), 2, "0"))
    return F.coalesce(name, F.lit(NO_TIME))


def _months(bucket: str) -> int:
    return int(bucket[:-3]) * 12 + int(bucket[-2:])

"""Irregular readings of many sources onto one regular grid per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.functions.cleaning import from_micros, micros, number_or_null
from lunario.session import shared_path

#: Periods in a block; windows run inside blocks, so that no source's grid lies in one task.
BLOCK = 1024
HOUR_US = 3_600_000_000


def periods_with_readings(readings: DataFrame, source: str, time: str, value: str, steps: DataFrame, step: str, origin_us: int) -> DataFrame:
    """Readings reduced to (source, step, period) with their count, total, least, greatest and last value."""
    us = micros(F.col(time))
    r = readings.select(F.col(source).alias("_id"), us.alias("_us"), number_or_null(F.col(value)).alias("_v"))
    r = r.where("_id is not null and _us is not null and _v is not null")
    s = steps.groupBy(F.col(source).alias("_id")).agg(F.min(F.col(step).cast("bigint")).alias("_step")).where("_id is not null and _step > 0")
    # Steps are whole hours, so readings are combined by hour before they meet their steps: what is shuffled by source
    # are hours, of which a source has no more than the time it spans, however many readings it has.
    hour = F.expr(f"floor((_us - {int(origin_us)}L) / {HOUR_US}L)").cast("bigint").alias("_hour")
    hours = r.groupBy("_id", hour).agg(
        F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.max(F.struct("_us", "_v")).alias("_last")
    )
    hours = hours.join(s, "_id").withColumn("_p", F.expr("floor(_hour / _step)").cast("bigint"))
    return hours.groupBy("_id", "_step", "_p").agg(
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.max("_last")["_v"].alias("_last")
    )


def regular_grid(
    readings: DataFrame,
    steps: DataFrame,
    *,
    source: str,
    time: str,
    value: str,
    step_hours: str,
    origin_us: int,
    max_gap: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """One row per source and period from its first to its last reading.

    The time sequence of each source is generated, the readings aggregated by period are left-joined to it, the
    last observation is carried forward over at most ``max_gap`` empty periods, and what is still empty is marked.

    Columns: the source, ``periodo`` (number of the period since the origin), ``inizio`` and ``fine`` (start,
    exclusive end), ``n_letture``, ``totale``, ``minimo``, ``massimo``, ``ultimo`` (null without reading),
    ``riportato`` (value carried into a period without reading, else null), ``stato`` (``letto``, ``riportato``,
    ``mancante``).

    A reading counts if source and time are not null and the value is a finite number. Of equal times the greatest
    value is the last. Sources without a positive step have no periods and give no row; a step given twice counts as
    the least. Repeated readings count each. Empty tables give no rows; further columns are ignored.

    Scale: readings are combined by (source, hour) before they meet the steps, so a source with a third of all
    readings is spread over its hours and comes to its step as no more rows than it spans hours. Sequences are made in blocks of ``block`` periods and windows run inside a block; only
    one row per block (last observation in it) is passed along a source.
    """
    known = periods_with_readings(readings, source, time, value, steps, step_hours, origin_us)
    known.write.parquet(kept := shared_path(readings.sparkSession, "p1-periodi"))  # blocks and grid need it; the readings are read once
    known = readings.sparkSession.read.parquet(kept)
    b = F.expr(f"floor(_p / {int(block)})").cast("bigint")
    per_block = known.groupBy("_id", b.alias("_b")).agg(
        F.min("_step").alias("_step"), F.min("_p").alias("_p0"), F.max(F.struct("_p", "_last")).alias("_tail")
    )
    # Blocks that hold a reading know the next such block; the blocks between are generated from it.
    along = Window.partitionBy("_id").orderBy("_b")
    blocks = (
        per_block.withColumn("_next", F.lead("_b").over(along))
        .withColumn("_carry", F.lag("_tail").over(along))
        .withColumn("_blk", F.explode(F.sequence(F.col("_b"), F.coalesce(F.col("_next") - 1, F.col("_b")))))
        .select(
            "_id", "_step", F.col("_blk").alias("_b"),
            F.when(F.col("_blk") > F.col("_b"), F.col("_tail")).otherwise(F.col("_carry")).alias("_carry"),
            F.when((F.col("_blk") == F.col("_b")) & F.col("_carry").isNull(), F.col("_p0")).otherwise(F.col("_blk") * block).alias("_from"),
            F.when((F.col("_blk") == F.col("_b")) & F.col("_next").isNull(), F.col("_tail")["_p"]).otherwise(F.col("_blk") * block + block - 1).alias("_to"),
        )
    )
    sequence = blocks.select("_id", "_step", "_carry", F.explode(F.sequence("_from", "_to")).alias("_p"))
    grid = sequence.join(known.drop("_step"), ["_id", "_p"], "left").withColumn("_b", b)
    within = Window.partitionBy("_id", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_n").isNotNull(), F.struct("_p", "_last")), ignorenulls=True).over(within)
    grid = grid.withColumn("_seen", F.coalesce(seen, F.col("_carry")))
    empty: Column = F.col("_n").isNull()
    near = F.col("_p") - F.col("_seen")["_p"] <= max_gap
    start = F.lit(int(origin_us)) + F.col("_p") * F.col("_step") * HOUR_US
    return grid.select(
        F.col("_id").alias(source),
        F.col("_p").alias("periodo"),
        from_micros(start).alias("inizio"),
        from_micros(start + F.col("_step") * HOUR_US).alias("fine"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_letture"),
        F.col("_sum").alias("totale"),
        F.col("_min").alias("minimo"),
        F.col("_max").alias("massimo"),
        F.col("_last").alias("ultimo"),
        F.when(empty & near, F.col("_seen")["_last"]).alias("riportato"),
        F.when(~empty, "letto").when(near, "riportato").otherwise("mancante").alias("stato"),
    )

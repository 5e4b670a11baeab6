"""Cumulative frequencies of weighted values: range-sorted, with a partition's offset added to its running sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.session import shared_path

#: Rows in an output batch.
BATCH = 100_000


def _reached(v: np.ndarray, w: np.ndarray, ends: np.ndarray, per_thousand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total weight, first values that reach the ranks) of runs of rows that end before ``ends``."""
    cum = np.cumsum(w)
    last = cum[ends - 1]
    base = np.r_[0, last[:-1]]
    n = last - base
    ranks = np.maximum(1, (n[:, None] * per_thousand + 999) // 1000)
    return n, v[np.searchsorted(cum, (base[:, None] + ranks).ravel())].reshape(ranks.shape)


def _runs(per_thousand: Sequence[int]):
    """Rows sorted by group and value -> finished groups, and the rows of groups that may go on in another partition."""
    ps = np.array(per_thousand, np.int64)

    def batch(names: list[str], part: int, g: pa.Array, v=None, w=None, cum=None, n=None, values=None) -> pa.RecordBatch:
        size = len(g)
        none = lambda t: pa.nulls(size, t)
        lists = none(pa.list_(pa.float64())) if values is None else pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * len(ps), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, part, np.int32)), g, *(none(t) if x is None else pa.array(x, t) for x, t in ((v, pa.float64()), (w, pa.int64()), (cum, pa.int64()), (n, pa.int64()))), lists], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), ["_part", "_g", "_v", "_w", "_cum", "_n", "_values"]
        open_: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the group that the last batch ended in
        group, edge, passed = None, True, 0  # edge: this group is the partition's first

        def loose(g: pa.Scalar, v: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal passed
            cum = passed + np.cumsum(w)
            passed = int(cum[-1]) if len(cum) else passed
            for k in range(0, len(v), BATCH):
                part_v = v[k : k + BATCH]
                yield batch(names, part, pa.array([g.as_py()] * len(part_v), g.type), part_v, w[k : k + BATCH], cum[k : k + BATCH])

        def finished(gs: pa.Array, v: np.ndarray, w: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            n, values = _reached(v, w, ends, ps)
            return batch(names, part, gs, n=n, values=values)

        for b in batches:
            v = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            keep = ~np.isnan(v)
            if not keep.any():
                continue
            g, v, w = b.column(0).filter(pa.array(keep)), v[keep], b.column(2).to_numpy(zero_copy_only=False)[keep]
            encoded = pc.run_end_encode(g)
            ends, own = np.array(encoded.run_ends, np.int64), encoded.values
            begins = np.r_[0, ends[:-1]]
            first = 0
            if group is not None and group == own[0]:
                if edge:
                    yield from loose(group, v[: ends[0]], w[: ends[0]])
                else:
                    open_.append((v[: ends[0]], w[: ends[0]]))
                first = 1
            if first == len(ends):
                continue
            if group is not None and not edge:  # the open group has ended inside the partition
                ov, ow = (np.concatenate(x) for x in zip(*open_, strict=True))
                yield finished(pa.array([group.as_py()], group.type), ov, ow, np.array([len(ov)]))
            elif group is None:  # the partition's first group
                group = own[0]
                yield from loose(group, v[: ends[0]], w[: ends[0]])
                first = 1
                if first == len(ends):
                    continue
            if first < len(ends) - 1:
                a, z = begins[first], ends[-2]
                yield finished(own[first : len(ends) - 1], v[a:z], w[a:z], ends[first:-1] - a)
            group, edge, open_ = own[len(ends) - 1], False, [(v[begins[-1] :], w[begins[-1] :])]
        if group is not None and not edge:
            passed = 0
            for ov, ow in open_:
                yield from loose(group, ov, ow)

    return run


def percentile_columns(counts: DataFrame, group: str, value: str, weight: str, per_thousand: Sequence[int], prefix: str = "p") -> DataFrame:
    """A row per group: ``n`` (total weight) and for each p the first value whose running weight reaches ceil(p/1000 x n), as ``p500``.

    ``counts`` has a row per group and distinct value with its weight (> 0); rows whose value is null or NaN are left
    out. Null groups are a group; groups without a value give no row.

    Rows are range-sorted by (group, value), so a group that holds most values lies in as many partitions as it fills.
    Groups that begin and end inside a partition are finished there. The rows of the others, two groups a partition at
    most, are written with their running sums to the shared folder; the sums of their partitions are added up along
    the group, and the rows in which a rank is reached are picked in the partitions that hold one. Ranges are chosen
    once and their rows written once, so a task that runs again changes nothing.
    """
    spark, ps = counts.sparkSession, [int(p) for p in per_thousand]
    c = counts.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"), F.col(weight).cast("bigint").alias("_w"))
    kind = c.schema["_g"].dataType.simpleString()
    ranged = c.repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v")
    done = ranged.mapInArrow(_runs(ps), f"_part int, _g {kind}, _v double, _w bigint, _cum bigint, _n bigint, _values array<double>")
    done.write.parquet(kept := shared_path(spark, "frequenze"))
    done = spark.read.parquet(kept)
    edge = done.where("_n is null")
    sums = edge.groupBy("_g", "_part").agg(F.sum("_w").alias("_s"))
    whole = Window.partitionBy("_g")  # a row a partition that the group lies in
    sums = sums.select("_g", "_part", "_s", (F.sum("_s").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_off"), F.sum("_s").over(whole).alias("_all"))
    rank = F.greatest(F.lit(1).cast("bigint"), F.expr("(_all * _p + 999) div 1000"))
    targets = sums.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in ps]))).withColumn("_rank", rank).where("_rank > _off and _rank <= _off + _s")
    targets = targets.groupBy("_g", "_part").agg(F.first("_off").alias("_off"), F.first("_all").alias("_all"), F.collect_list(F.struct("_p", "_rank")).alias("_t"))
    at = F.col("_off") + F.col("_cum")
    hit = edge.alias("e").join(targets.alias("t"), F.col("e._g").eqNullSafe(F.col("t._g")) & (F.col("e._part") == F.col("t._part")))
    hit = hit.select(F.col("e._g").alias("_g"), "_v", "_all", F.explode(F.filter("_t", lambda t: (t["_rank"] <= at) & (t["_rank"] > at - F.col("_w")))).alias("_t"))
    wide = hit.groupBy("_g").agg(F.max("_all").alias("n"), *[F.max(F.when(F.col("_t._p") == p, F.col("_v"))).alias(f"{prefix}{p:03d}") for p in ps])
    inner = done.where("_n is not null").select("_g", F.col("_n").alias("n"), *[F.get("_values", F.lit(k)).alias(f"{prefix}{p:03d}") for k, p in enumerate(ps)])
    return inner.unionByName(wide).withColumnRenamed("_g", group)

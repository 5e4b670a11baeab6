"""A training mix of fixed-length token blocks in which each source has its target share."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lunario.llm.automaton import compiled
from lunario.llm.tokenize import vocabulary
from lunario.session import shared_path


@dataclass(frozen=True)
class Plan:
    """What is drawn: blocks of ``length`` tokens, ``per_shard`` slots in an output shard, and the seed of all draws.

    ``group`` shards are drawn in one go; only sums of groups are added up along the whole mix.
    """

    length: int = 256
    per_shard: int = 64
    seed: int = 20_240_613
    group: int = 1024


def feistel(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, applied to the indices.

    Four Feistel rounds over the least even number of bits that hold ``size``; images outside are permuted again until
    they fall inside, so the map stays one to one.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = (right ^ k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            left, right = right, left ^ (x & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def blocks(documents: DataFrame, targets: DataFrame, *, doc: str, text: str, source: str, path: str, plan: Plan) -> DataFrame:
    """(source, blocco, n_token, documenti, ids): each source's texts end to end, cut every ``length`` tokens.

    Only sources with a target. Texts are encoded, joined and cut where they are read, so no text and no token is
    shuffled: each part of the input (a task) has blocks of its own, and the last block of a source in a part may be
    shorter; nothing is dropped. ``blocco`` numbers a source's blocks from 0 on, part after part. The blocks are
    written to the shared folder, so a task that runs again changes none.
    """
    spark = documents.sparkSession
    wanted = [r[0] for r in targets.select(source).where(F.col(source).isNotNull()).distinct().limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"A mix has at most {MOST_SOURCES} sources")
    named = documents.where(F.col(source).isin(wanted) & (F.length(text) > 0)).select(source, doc, text)
    words, length = vocabulary(spark, path), plan.length
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, doc_type = compiled(words.value), None
        part = TaskContext.get().partitionId()
        rest: dict[str, tuple[np.ndarray, deque]] = {}  # source -> tokens not cut yet, (document, tokens) of these
        made: dict[str, int] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names, numbers, docs, ids = zip(*rows, strict=True)
            sizes = np.array([len(x) for x in ids])
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(docs, pa.list_(doc_type)), lists],
                [source, "_part", "_n", "n_token", "documenti", "ids"],
            )

        def take(name: str, upto: int, tokens: np.ndarray, owners: deque) -> tuple[list[tuple], np.ndarray]:
            rows, at = [], 0
            while len(tokens) - at >= upto and len(tokens) > at:
                size, docs, left = min(length, len(tokens) - at), [], min(length, len(tokens) - at)
                while left:
                    d, n = owners[0]
                    docs.append(d)
                    used = min(n, left)
                    left -= used
                    if used == n:
                        owners.popleft()
                    else:
                        owners[0] = (d, n - used)
                rows.append((name, made.get(name, 0), list(dict.fromkeys(docs)), tokens[at : at + size]))
                made[name] = made.get(name, 0) + 1
                at += size
            return rows, tokens[at:]

        for b in batches:
            doc_type, rows = b.column(1).type, []
            by_source: dict[str, list[bytes]] = {}
            for name, d, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found = automaton.encode_bytes(t)
                by_source.setdefault(name, []).append(found)
                rest.setdefault(name, (np.zeros(0, np.int32), deque()))[1].append((d, len(found) // 4))
            for name, pieces in by_source.items():
                before, owners = rest[name]
                full, tokens = take(name, length, np.concatenate([before, np.frombuffer(b"".join(pieces), np.int32)]), owners)
                rest[name] = tokens, owners
                rows += full
            for k in range(0, len(rows), 4096):
                yield out(rows[k : k + 4096])
        rows = [r for name, (tokens, owners) in rest.items() for r in take(name, 1, tokens, owners)[0]]
        if rows:
            yield out(rows)

    ddl = f"`{source}` string, _part int, _n bigint, n_token int, documenti array<{kinds[doc]}>, ids array<int>"
    named.mapInArrow(cut, ddl).write.parquet(kept := shared_path(spark, "p8-blocchi"))
    there = spark.read.parquet(kept)
    counts = there.groupBy(source, "_part").agg(F.count("*").alias("_c"))  # a row a source and part
    before = F.sum("_c").over(Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    first = counts.select(source, "_part", before.alias("_first"))
    numbered = there.join(F.broadcast(first) if first.count() <= MOST_PARTS else first, [source, "_part"])
    return numbered.select(source, (F.col("_first") + F.col("_n")).alias("blocco"), "n_token", "documenti", "ids")


#: Sources in a mix at most; each shard has a number for each.
MOST_SOURCES = 1000
#: Rows of (source, part) that are sent to every executor; more are joined as Spark sees fit.
MOST_PARTS = 200_000


def shard_counts(shards: np.ndarray, shares: np.ndarray, plan: Plan) -> np.ndarray:
    """Slots of each source in each shard: rows of whole numbers that add up to ``per_shard``.

    Every source has the whole part of its expected slots; what is left is drawn from a multinomial distribution over
    the fractions, by a generator of the shard's own. The expected count is the share times the slots, as in a draw of
    all slots, but most of the chance is gone. A shard's draw depends on the seed and its number only, so any task
    that needs it draws it again.
    """
    expected = shares * plan.per_shard
    sure = np.floor(expected + 1e-9).astype(np.int64)
    rest = plan.per_shard - int(sure.sum())
    odds = np.maximum(expected - sure, 0)
    out = np.tile(sure, (len(shards), 1))
    if rest > 0:
        odds = odds / odds.sum()
        for i, k in enumerate(shards.tolist()):
            out[i] += np.random.Generator(np.random.Philox(key=[plan.seed, k])).multinomial(rest, odds)
    return out


@dataclass
class Sources:
    """What is known of each source before a draw; one entry a source."""

    rows: list[tuple]  # source, target share, share among sources with blocks, most repeats, blocks
    names: list[str]  # those that are drawn
    shares: np.ndarray
    have: np.ndarray
    most: np.ndarray  # draws at most


def usable(have: dict[str, int], targets: list[tuple[str, float, int]]) -> Sources:
    """Sources without a block, a share or a use are left out, and the other shares scaled to 1."""
    ok = [(s, share, r) for s, share, r in targets if have.get(s, 0) > 0 and share > 0 and r > 0]
    scale, names = sum(share for _, share, _ in ok), {s for s, _, _ in ok}
    rows = [(s, share, share / scale if s in names else 0.0, r, have.get(s, 0)) for s, share, r in targets]
    blocks_ = np.array([have[s] for s, _, _ in ok], np.int64)
    return Sources(rows, [s for s, _, _ in ok], np.array([share / scale for _, share, _ in ok]), blocks_, blocks_ * np.array([r for _, _, r in ok], np.int64))


def draw(spark: SparkSession, sources: Sources, plan: Plan, total: int | None = None, short: bool = False) -> DataFrame:
    """(shard, source index ``k``, slots ``n``, first draw ``first``, ``have``): the slots of each shard by source, drawn on the executors.

    Shard after shard, each source's draws are numbered on. ``total`` slots are drawn (whole shards), or as many as
    the sources allow: the mix ends before the first shard for which a source has no more uses. With ``short`` it goes
    on to ``total``; what a source cannot give is missing from its shards and in the report.

    The number of groups of ``plan.group`` shards is all that is added up in one place: a row of sums each.
    """
    many = len(sources.names)
    bound = int(min(sources.most / np.maximum(sources.shares, 1e-300), default=0)) if many else 0
    slots = total if short and total is not None else min(bound + plan.per_shard * plan.group, total if total is not None else bound + plan.per_shard * plan.group)
    shards = slots // plan.per_shard if many else 0
    groups = -(-shards // plan.group)
    shares, most, have, per = sources.shares, sources.most, sources.have, plan.group

    def of_group(g: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(g * per, min((g + 1) * per, shards))
        return k, shard_counts(k, shares, plan)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(0).to_pylist()
            totals = [of_group(x)[1].sum(axis=0) for x in g]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g, many), pa.int64()), pa.array(list(range(many)) * len(g), pa.int32()), pa.array(np.concatenate(totals) if totals else [], pa.int64())], ["g", "k", "n"])

    ids = spark.range(0, groups, 1, max(1, min(groups, 4 * spark.sparkContext.defaultParallelism)))
    along = Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    offsets = ids.mapInArrow(sums, "g bigint, k int, n bigint").withColumn("first", F.sum("n").over(along) - F.col("n"))
    by_group = offsets.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "first"))).alias("a")).select("g", F.col("a.first").alias("first"))

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begin = np.array(first, np.int64)
                if not short and (begin > most).any():
                    continue  # the mix has ended before this group
                k, counts = of_group(g)
                firsts = begin + np.cumsum(counts, axis=0) - counts
                if not short:
                    over = (firsts + counts > most).any(axis=1)
                    end = int(np.argmax(over)) if over.any() else len(k)
                else:
                    counts, end = np.clip(most - firsts, 0, counts), len(k)
                at, src = np.nonzero(counts[:end])
                yield pa.RecordBatch.from_arrays([pa.array(k[at], pa.int64()), pa.array(src.astype(np.int32)), pa.array(counts[at, src]), pa.array(firsts[at, src]), pa.array(have[src])], ["shard", "k", "n", "first", "have"])

    return by_group.mapInArrow(shards_of, "shard bigint, k int, n bigint, first bigint, have bigint")


def mix(documents: DataFrame, targets: DataFrame, *, doc: str, text: str, source: str, share: str, repeats: str, path: str, plan: Plan = Plan(), total: int | None = None, short: bool = False):
    """(mix, report).

    mix: one row per slot: ``shard``, ``slot``, the source, ``blocco``, ``volta`` (0 for the first use of the block),
    ``n_token``, ``documenti`` and ``ids``. report: one row per target: ``target_share``, ``quota_utile`` (its share
    among the sources that have documents), ``max_repeats``, ``blocchi`` there and ``blocchi_estratti``, ``token`` and
    ``quota`` reached, ``volte`` (most uses of a block).

    Source counts of a shard are drawn as :func:`shard_counts` says. A source's draws go through a new permutation of
    its blocks for each pass, so all its blocks are used before one is used again and none, hence no document, more
    than ``max_repeats`` times. The scarcest source bounds the mix; with ``short`` and ``total`` it does not, and its
    missing slots stay empty. Documents without text or of a source without target do not take part; targets of one
    source given twice count with the least share and repeats. Empty tables give an empty mix.

    Scale: the driver holds one row per source. Shards are drawn on the executors, blocks and slots meet by (source,
    block), which spreads large sources; texts are encoded once, and tokens are shuffled once, in that join.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(share).alias("s"), F.min(repeats).alias("r"))
    goals = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in wanted.orderBy(source).collect()]
    there = blocks(documents, targets, doc=doc, text=text, source=source, path=path, plan=plan)
    have = {r[0]: r[1] for r in there.groupBy(source).count().collect()}
    known = usable(have, goals)
    if short and total is None:
        raise ValueError("A mix with missing slots needs a total")
    drawn, names, seed = draw(spark, known, plan, total, short), np.array([*known.names, ""], object), plan.seed
    slots = drawn.select("shard", "have", "k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("g"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, have_, k, g = (b.column(i).to_numpy() for i in range(4))
            turn = g // have_
            at = feistel(g % have_, have_, seed + 1_000_003 * k.astype(np.int64) + 7_919 * turn)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[k], pa.string()), pa.array(at, pa.int64()), pa.array(turn.astype(np.int32))], ["shard", source, "blocco", "volta"])

    placed = slots.mapInArrow(place, f"shard bigint, `{source}` string, blocco bigint, volta int")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", source, "blocco", "volta"), source, "blocco", "volta")
    slotted = placed.withColumn("slot", F.row_number().over(order) - 1)  # a shard has at most ``per_shard`` slots
    # Spark takes the size of the slots from the few groups they are made from and would send them to every executor.
    mixed = slotted.hint("merge").join(there, [source, "blocco"]).select("shard", "slot", source, "blocco", "volta", "n_token", "documenti", "ids")
    goal = spark.createDataFrame(known.rows, f"`{source}` string, target_share double, quota_utile double, max_repeats int, blocchi bigint")
    used = placed.groupBy(source, "blocco").agg(F.count("*").alias("u")).hint("merge").join(there.select(source, "blocco", "n_token"), [source, "blocco"])
    used = used.groupBy(source).agg(F.sum("u").alias("blocchi_estratti"), F.sum(F.col("u") * F.col("n_token")).alias("token"), F.max("u").alias("volte"))
    report = goal.join(used, source, "left").na.fill(0, ["blocchi_estratti", "token", "volte"])
    report = report.withColumn("quota", F.col("token") / F.nullif(F.sum("token").over(Window.partitionBy(F.lit(1))), F.lit(0)))  # one row a target
    return mixed, report

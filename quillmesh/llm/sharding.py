"""Sharding by balanced label propagation (law `rows`: shards' row counts are at most one apart).

Documents with equal texts are linked. All documents start in the shard that a hash of their row names. In each round the
rows of a link group are counted by shard, and each part of a group moves to the shard where most of its neighbours are,
if that shard has room: a shard's quota is its capacity for linked rows less what it holds and keeps, and of the moves that
ask for it a share by the group's hash is let in, so that the expected size stays within the capacity. Parts of groups that
are large against a shard, of which there can only be few, move one by one before, while there is room. Only summed rows of
groups with two or more documents take part; what comes back to the driver is one number for each pair of shards, and the
parts of large groups. Documents without a link need no quota, as they can make room without cutting a link.

The last step makes the sizes exact and moves nothing else: a shard that holds more than its share gives its surplus, rows
without a link first and then groups in the order of their hash, to the shards that hold less. For this the rows are
range-sorted by (shard, linked, group, id) and numbered by running sums within the ranges.

Defined results: a null text has size 1 (no bytes) and is linked with the empty text. Very long texts are only hashed. Null
ids sort first. Repeated rows are separate rows of one group; ties are settled by shard number. With fewer rows than shards
some shards are empty. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget
from .common import stored, text_of

ROUNDS = 6
SLACK = 1.05


def gathered(parts: list, full: dict[int, int], capacity: float) -> list:
    """parts (g, s0, s, n) of large groups -> (g, s0, s): each goes to the shard with most of its group that has room for it.

    `full` is kept up to date. A move brings a part to a larger one, so that the moves come to an end.
    """
    held: dict = {}
    for g, _, s, n in parts:
        held.setdefault(g, {}).setdefault(s, 0)
        held[g][s] += n
    parts, moved = sorted(parts), True
    while moved:
        moved = False
        for i, (g, s0, s, n) in sorted(enumerate(parts), key=lambda x: (held[x[1][0]][x[1][2]], x[1])):
            v = held[g]
            better = [t for t in v if (v[t], -t) > (v[s], -s) and full[t] + n <= capacity]
            if better:
                t = max(better, key=lambda t: (v[t], -t))
                v[t], v[s], full[t], full[s] = v[t] + n, v[s] - n, full[t] + n, full[s] - n
                parts[i], moved = (g, s0, t, n), True
    return [(g, s0, s) for g, s0, s, _ in parts]


def propagate(linked: DataFrame, total: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """linked(g, s0, n): rows of group g that start in shard s0, of `total` rows in all -> (g, s0, s): where they go."""
    state = stored(linked.withColumn("s", F.col("s0")), "labels")
    capacity = SLACK * total / shards
    sums = lambda df: {t: 0 for t in range(shards)} | {r[0]: r[1] for r in df.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    if not rounds:
        return state.select("g", "s0", "s")
    # at most shards ** 2 groups are large, with at most `shards` parts each
    large = state.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") > capacity / shards).select("g")
    full = sums(state)
    done = gathered([(r["g"], r["s0"], r["s"], r["n"]) for r in state.join(large, "g").select("g", "s0", "s", "n").collect()], full, capacity)
    done = state.sparkSession.createDataFrame(done, state.select("g", "s0", "s").schema)
    state = state.join(large, "g", "left_anti")
    for i in range(rounds):
        votes = state.groupBy("g", "s").agg(F.sum("n").alias("v"))
        free = [t for t in range(shards) if full[t] < 0.98 * capacity]
        wish = votes.groupBy("g").agg(F.max_by("s", F.struct(F.col("s").isin(free).alias("room"), "v", (-F.col("s")).alias("low"))).alias("to"))
        asked = state.join(wish, "g").where(F.col("to").isin(free) & (F.col("s") != F.col("to")))
        flow = {(r[0], r[1]): r[2] for r in asked.groupBy("s", "to").agg(F.sum("n").alias("n")).collect()}
        if not flow:
            break
        into = {t: sum(n for (_, b), n in flow.items() if b == t) for t in range(shards)}
        # rows that leave make room, but only as far as others let them in
        share = dict.fromkeys(range(shards), 1.0)
        for _ in range(20):
            gone = {a: sum(n * share[b] for (x, b), n in flow.items() if x == a) for a in range(shards)}
            share = {t: min(1.0, max(0.0, capacity - full[t] + gone[t]) / into[t]) if into[t] else 1.0 for t in range(shards)}
        let_in = F.create_map(*[F.lit(x) for t in range(shards) for x in (t, float(share[t]))])
        lot = F.pmod(F.xxhash64("g", F.lit(i)), F.lit(1 << 20)) / float(1 << 20)
        moved = asked.where(lot < let_in[F.col("to")]).select("g", "s0", "to")
        old, state = state, stored(state.join(moved, ["g", "s0"], "left").select("g", "s0", "n", F.coalesce("to", "s").alias("s")), "labels")
        now = sums(state)
        fixed = {t: full[t] - n for t, n in sums(old).items()}
        full = {t: fixed[t] + now[t] for t in range(shards)}
        forget(old)
    return state.select("g", "s0", "s").unionByName(done)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "local"])
        at += n


def evened(counts: dict[int, int], shards: int) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Rows that each shard holds and gives away, and (shard, first, end) among all rows given away for those that receive.

    Of the sizes, one apart at most, the larger ones go to the shards that hold most.
    """
    held = [counts.get(t, 0) for t in range(shards)]
    least, more = divmod(sum(held), shards)
    size = [0] * shards
    for i, t in enumerate(sorted(range(shards), key=lambda t: (-held[t], t))):
        size[t] = least + (i < more)
    given, receive, at = [max(0, h - n) for h, n in zip(held, size, strict=True)], [], 0
    for t in range(shards):
        if size[t] > held[t]:
            receive.append((t, at, at := at + size[t] - held[t]))
    return held, given, receive


def cut_rows(placed: DataFrame, group: str = "text_crc32") -> int:
    """How many rows are apart from the largest part of their group: 0 if no group is cut."""
    parts = placed.groupBy(group, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg((F.sum("n") - F.max("n")).alias("n"))
    return parts.agg(F.sum("n")).first()[0] or 0


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    kind = dict(docs.dtypes)[key]
    text = text_of()
    base = docs.select(
        F.col(f"`{key}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"), F.octet_length(text).alias("l")).alias("g"),
    )
    base = stored(base.withColumn("s0", F.pmod(F.xxhash64("id", "g.h"), F.lit(shards)).cast("int")), "rows")
    counts = base.groupBy("g", "s0").agg(F.count(F.lit(1)).alias("n"))
    many = counts.groupBy("g").agg(F.sum("n").alias("all")).where("all >= 2").select("g")
    labels = propagate(counts.join(many, "g"), base.count(), shards, rounds)
    placed = base.join(labels, ["g", "s0"], "left").withColumn("linked", F.col("s").isNotNull()).withColumn("s", F.coalesce("s", "s0"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("s", "linked", "h", "id", "crc")
    lined = placed.select("id", "size", "crc", "s", "linked", "g.h").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stored(lined.mapInArrow(_numbered, f"id {kind}, size long, crc long, s int, linked boolean, h long, part long, local long"), "numbered")
    forget(base)
    # one row for each partition, one number for each shard
    ranges = numbered.groupBy("part").agg((F.max("local") + 1).alias("many"))
    base_of = ranges.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))
    held, given, receive = evened({r[0]: r[1] for r in numbered.groupBy("s").count().collect()}, shards)
    by_shard = lambda v: F.element_at(F.array(*[F.lit(x).cast("long") for x in v]), F.col("s") + 1)
    starts, before = np.concatenate([[0], np.cumsum(held)]).tolist(), np.concatenate([[0], np.cumsum(given)]).tolist()
    place, move = F.col("before") + F.col("local") - by_shard(starts[:-1]), by_shard(before[:-1]) + F.col("place")
    to, slot = F.col("s"), F.col("place") - F.col("given")
    for t, first, end in receive:
        here = (F.col("move") >= first) & (F.col("move") < end)
        to, slot = F.when(here, t).otherwise(to), F.when(here, F.col("move") - first + held[t]).otherwise(slot)
    return (
        numbered.join(F.broadcast(base_of), "part")
        .withColumn("place", place).withColumn("given", by_shard(given))
        .withColumn("move", F.when(F.col("place") < F.col("given"), move))
        .select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

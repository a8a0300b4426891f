"""Operator 3: best-fit-decreasing sharding of indivisible groups.

A group is all documents of one text.  Groups are packed twice, both times longest
first into the bin with the least room that still fits, found in a balanced tree:
first within hash partitions into units of about 1/UNITS of all bytes, then, on the
driver, units and large groups into shards of one capacity.  The driver sees at most
2 * UNITS large groups and 2 * UNITS + partitions units, however many groups exist.

Defined results: null text has size 1, crc32 0, and forms one group of its own, apart
from the empty text's; rows that repeat each get a slot; a null doc_id is placed like
others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Units that all bytes are cut into at least; bounds what the driver packs.
UNITS = 2048
#: Groups that one task packs into units, and tasks at most.
GROUPS_PER_TASK, MOST_TASKS = 100_000, 16_384


class RoomTree:
    """A treap of (room, bin), balanced by hashed priorities."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _priority(bin_: int) -> int:
        x = (bin_ + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return x ^ x >> 31

    def add(self, room: int, bin_: int) -> None:
        key, rank = (room, bin_), self._priority(bin_)
        new = [key, rank, None, None]
        parent, side, node = None, 0, self.root
        while node is not None and node[1] >= rank:
            parent, side = node, 2 if key < node[0] else 3
            node = node[side]
        small = large = None  # split what hangs here round the key
        hooks = [(new, 2), (new, 3)]
        while node is not None:
            if node[0] < key:
                hooks[0][0][hooks[0][1]], hooks[0] = node, (node, 3)
                node = node[3]
            else:
                hooks[1][0][hooks[1][1]], hooks[1] = node, (node, 2)
                node = node[2]
        hooks[0][0][hooks[0][1]], hooks[1][0][hooks[1][1]] = small, large
        if parent is None:
            self.root = new
        else:
            parent[side] = new

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least ``need``."""
        best, best_at, parent, side, node = None, None, None, 0, self.root
        while node is not None:
            if node[0][0] >= need:
                best, best_at = node, (parent, side)
                parent, side, node = node, 2, node[2]
            else:
                parent, side, node = node, 3, node[3]
        if best is None:
            return None
        a, b, hook, at = best[2], best[3], *best_at
        while a is not None or b is not None:  # merge its children
            if b is None or a is not None and a[1] >= b[1]:
                child, a, down = a, a[3], 3
            else:
                child, b, down = b, b[2], 2
            if hook is None:
                self.root = child
            else:
                hook[at] = child
            hook, at = child, down
        if hook is None:
            self.root = None
        else:
            hook[at] = None
        return best[0]


def best_fit(sizes, capacity: int) -> tuple[list[int], int]:
    """Bin of each size; ``sizes`` come largest first.  A size over ``capacity`` has a bin alone."""
    tree, where, bins = RoomTree(), [], 0
    for size in sizes:
        found = tree.pop_tightest(size)
        room, chosen = found if found else (capacity, bins)
        bins += found is None
        where.append(chosen)
        if room > size:
            tree.add(room - size, chosen)
    return where, bins


def fewest_shards(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, int]:
    """Shard of each item at the least capacity at which best-fit-decreasing needs ``shards`` bins at most.

    An item over its fair share of what is left has a shard alone, the largest first, and the rest
    share the other shards at a capacity of their own, which is returned.
    """
    order = np.argsort(-sizes, kind="stable")
    down = sizes[order].tolist()
    alone, left = 0, sum(down)
    while alone < min(shards - 1, len(down)) and down[alone] * (shards - alone) > left:
        left -= down[alone]
        alone += 1
    down, shards = down[alone:], shards - alone
    low, high = max(-(-sum(down) // shards), down[0] if down else 0), None
    step, capacity, best = max(1, low // 4096), low, None
    while high is None or low < high:
        where, bins = best_fit(down, capacity)
        if bins <= shards:
            best, high = where, capacity
        else:
            low, step = capacity + 1, step * 2
        capacity = low + step if high is None else (low + high) // 2
        if high is not None and high - low <= max(1, high // 100_000):
            break
    out = np.empty(len(sizes), np.int64)
    out[order] = [*range(alone), *(alone + b for b in best)]
    return out, high


def _units(groups: DataFrame, tasks: int, unit_bytes: int) -> DataFrame:
    """``key, unit`` of small groups, packed within hash partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tree, bins = TaskContext.get().partitionId() << 32, RoomTree(), 0
        for batch in batches:  # sorted largest first: the open bins are all that is kept
            where = []
            for size in batch.column("bytes").to_pylist():
                found = tree.pop_tightest(size)
                room, chosen = found if found else (unit_bytes, bins)
                bins += found is None
                where.append(task | chosen)
                if room > size:
                    tree.add(room - size, chosen)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(where, pa.int64()), batch.column("bytes"), batch.column("n")], names=["key", "unit", "bytes", "n"])

    dealt = groups.repartition(tasks, "key").sortWithinPartitions(F.desc("bytes"), "key")
    return dealt.select("key", "bytes", "n").mapInArrow(pack, "key binary, unit long, bytes long, n long")


def shard_documents(docs: DataFrame, shards: int = 8, capacity: int | None = None, unit_parts: int = UNITS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; equal texts share a shard.

    With ``capacity`` the number of shards is what best fit needs (units are then at most
    a sixteenth of it); otherwise ``shards`` shards of the least capacity found.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = stored(
        docs.select(
            "doc_id", size.alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"\0")).alias("key"),
        ),
        "sizes",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, count, number = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    total, count = total or 0, count or 0
    unit_bytes = max(1, -(-total // unit_parts), *([] if capacity is None else [min(capacity // 16, total)]))
    if capacity is not None:
        unit_bytes = max(1, min(unit_bytes, capacity // 16))
    large = (F.col("bytes") >= unit_bytes) | (F.col("n") > max(1, count // unit_parts))
    big = groups.filter(large).orderBy(F.desc("bytes"), "key").collect()
    tasks = min(MOST_TASKS, max(1, -(-number // GROUPS_PER_TASK)))
    small = stored(_units(groups.filter(~large), tasks, unit_bytes), "units")
    units = small.groupBy("unit").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("unit").collect()
    items = [(-1 - k, g["bytes"], g["n"]) for k, g in enumerate(big)] + [(u["unit"], u["bytes"], u["n"]) for u in units]
    sizes = np.array([x[1] for x in items], np.int64)
    if capacity is None:
        where, _ = fewest_shards(sizes, shards)
    else:
        order = np.argsort(-sizes, kind="stable")
        where = np.empty(len(sizes), np.int64)
        where[order] = best_fit(sizes[order].tolist(), capacity)[0]
    # slots: a unit's rows are numbered after those of its shard's earlier units; large
    # units are cut into hashed parts so that no task numbers more than a bounded share
    share = min(100_000, max(256, count // 1024))
    begun: dict[int, int] = {}
    placed = []
    for (unit, _, n), shard in zip(items, where.tolist(), strict=True):
        placed.append((unit, int(shard), begun.get(shard, 0), -(-n // share)))
        begun[shard] = begun.get(shard, 0) + n
    places = F.broadcast(spark.createDataFrame(placed, "unit long, shard int, base long, parts int"))
    keys = F.broadcast(spark.createDataFrame([(bytes(g["key"]), -1 - k) for k, g in enumerate(big)], "key binary, unit long"))
    with_unit = rows.join(keys, "key").select(*rows.columns, "unit").unionByName(
        rows.join(keys, "key", "left_anti").join(small.select("key", "unit"), "key").select(*rows.columns, "unit")
    )
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts").cast("long"))
    dealt = stored(with_unit.join(places, "unit").withColumn("part", part).drop("key"), "dealt")
    counts = dealt.filter("parts > 1").groupBy("unit", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = stored(counts.select("unit", "part", before.alias("before")), "before")
    number_in = F.row_number().over(Window.partitionBy("unit", "part").orderBy("doc_id", "text_crc32"))
    return (
        dealt.withColumn("rank", number_in)
        .join(before, ["unit", "part"], "left")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.coalesce("before", F.lit(0)) + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

"""Operator 5: exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers and cut into blocks of rows.  For every attribute a
block keeps bitmaps: slice s holds bit s of the attribute's high part for all rows.  A
query adds the slices, each as often as its own integer weight says, with full adders on
whole bitmaps (a digit of the weight shifts a slice up, a negative digit adds its complement).
The sum's slices, read from the most significant down, give the k-th largest sum; the low
bits that the index leaves out move a score by a known bound, so rows within it of that sum
are the boundary, and these alone are scored exactly.  The best k of each block
merge into the best k of all.

Queries travel in chunks of some megabytes, so the index moves once for thousands of them.

Defined results: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part; of rows with one id the vector that sorts first counts; vectors
of fewer dimensions end in zeros; ties go to the smaller id; fewer candidates than k give all
of them; scaled components and scores beyond 64 bits count as the largest or smallest long
(blocks that hold such are scored row by row); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block, about; bytes of the queries that meet a block together, about.
BLOCK_ROWS, CHUNK_BYTES = 12_288, 8 << 20
#: Low bits that slices leave to the exact step.
LOW_BITS = 4
#: Spread of values up to which a block is sliced.
MOST_SPREAD = 1 << 40
#: A block's ids, quantised rows (values of ``width`` bytes), least high part and bits of every attribute, and the slices.
INDEX = "block long, ids binary, width int, rows binary, low binary, bits binary, planes binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v``: floor(scale * component) as longs, one row an id."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & usable)
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _slices(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all attributes' bits, and the bits of each attribute."""
    planes, wide = [], []
    for d in range(high.shape[1]):
        column = high[:, d]
        bits = int(column.max()).bit_length()
        wide.append(bits)
        for b in range(bits):
            planes.append(np.packbits((column >> b & 1).astype(np.uint8), bitorder="little"))
    return (np.stack(planes) if planes else np.empty((0, len(high) // 8), np.uint8)), np.array(wide, np.int64)


def build_index(rows: DataFrame, blocks: int, low_bits: int = LOW_BITS) -> DataFrame:
    """A row a block: its ids, quantised rows and bit slices, each the bytes of one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:  # a partition is a block: ids are distinct, so hashing deals evenly
            ids += batch.column("id").to_pylist()
            held += [v.values.to_numpy() for v in batch.column("v")]
        if not held:
            return
        wide = max(map(len, held))
        full = np.zeros((len(held), wide), np.int64)
        for k, v in enumerate(held):
            full[k, : len(v)] = v
        least, most = int(full.min(initial=0)), int(full.max(initial=0))
        low, bits, planes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
        if most - least < MOST_SPREAD:
            low = full.min(0) >> low_bits
            high = np.zeros((-(-len(held) // 64) * 64, wide), np.int64)
            high[: len(held)] = (full >> low_bits) - low
            planes, bits = _slices(high)
        small = full.astype(np.int16) if -(1 << 15) <= least and most < 1 << 15 else full
        row = [TaskContext.get().partitionId(), np.array(ids, np.int64).tobytes(), small.itemsize, small.tobytes(), low.tobytes(), bits.tobytes(), planes.tobytes()]
        kinds = (pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "ids", "width", "rows", "low", "bits", "planes"])

    return rows.repartition(blocks, "id").sortWithinPartitions("id").select("id", "v").mapInArrow(run, INDEX)


def _digits(weight: int) -> list[tuple[int, int]]:
    """Signed binary digits without neighbours: (shift, sign)."""
    out, shift, sign = [], 0, 1 if weight >= 0 else -1
    weight = abs(weight)
    while weight:
        if weight & 1:
            d = 2 - (weight & 3)
            out.append((shift, d * sign))
            weight -= d
        weight >>= 1
        shift += 1
    return out


class Adder:
    """Sums bitmaps by column: three of one weight become one, and one of the next."""

    def __init__(self, words: int):
        self.columns: dict[int, list[np.ndarray]] = {}
        self.words = words

    def add(self, shift: int, bitmap: np.ndarray) -> None:
        self.columns.setdefault(shift, []).append(bitmap)

    def total(self) -> list[np.ndarray]:
        """Slices of the sum, least significant first."""
        zero, out, shift = np.zeros(self.words, np.uint64), [], 0
        while self.columns:
            column = self.columns.pop(shift, [])
            carry = self.columns.get(shift + 1, [])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                column.insert(0, ab ^ c)
                carry.append((a & b) | (ab & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                carry.append(a & b)
            if carry:
                self.columns[shift + 1] = carry
            out.append(column[0] if column else zero)
            shift += 1
        return out


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows``, from the most significant slice down."""
    tied, above, value = rows, 0, 0
    for s in range(len(slices) - 1, -1, -1):
        ones = tied & slices[s]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            tied, value = ones, value | 1 << s
        else:
            above += n
            tied = tied & ~slices[s]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Rows whose sum is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return np.zeros_like(rows)
    more, tied = np.zeros_like(rows), rows
    for s in range(len(slices) - 1, -1, -1):
        if value >> s & 1:
            tied = tied & slices[s]
        else:
            more |= tied & slices[s]
            tied = tied & ~slices[s]
    return more | tied


def clipped_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; one beyond 64 bits is the largest or smallest long."""
    if np.abs(rows.astype(float)).max(initial=0) * np.abs(query.astype(float)).sum() < 2.0**62:
        return rows @ query
    full = [sum(a * b for a, b in zip(r, query.tolist(), strict=True)) for r in rows.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in full], np.int64)


def search_block(block: dict, query_ids, queries: list[np.ndarray], k: int, low_bits: int = LOW_BITS):
    """(query, row ids, scores) of the best k rows of one block of the index for each query."""
    ids = np.frombuffer(block["ids"], np.int64)
    words = -(-len(ids) // 64)
    exact = np.frombuffer(block["rows"], np.int16 if block["width"] == 2 else np.int64).reshape(len(ids), -1).astype(np.int64)
    bits = np.frombuffer(block["bits"], np.int64)
    first = np.concatenate(([0], np.cumsum(bits)))[:-1]
    planes = np.frombuffer(block["planes"], np.uint64).reshape(-1, words)
    everyone = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    spot = {int(i): r for r, i in enumerate(ids)}
    for query_id, query in zip(query_ids, queries, strict=True):
        q = np.zeros(exact.shape[1], np.int64)
        q[: len(query)] = query[: len(q)]
        rows = everyone
        if query_id in spot:
            rows = rows.copy()
            rows[spot[query_id] // 64] &= ~(np.uint64(1) << np.uint64(spot[query_id] % 64))
        left = int(np.bitwise_count(rows).sum())
        if not left:
            continue
        near = rows
        if len(bits) == len(q) and np.abs(q.astype(float)).sum() < MOST_SPREAD:
            adder = Adder(words)
            for d in np.flatnonzero(q):
                for shift, sign in _digits(int(q[d])):
                    for b in range(bits[d]):
                        plane = planes[first[d] + b]
                        # a complement adds 1 - bit: the constant it adds is the same for every row
                        adder.add(shift + b, plane if sign > 0 else ~plane)
            slices = adder.total()
            # what the low bits may add: from slack_low to slack_high
            spread = (1 << low_bits) - 1
            slack = int(np.abs(q).sum()) * spread
            kth = kth_largest(slices, rows, min(k, left))
            near = at_least(slices, rows, kth - -(-slack // (1 << low_bits)))
        found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        scores = clipped_scores(exact[found], q)
        best = np.lexsort((ids[found], -scores.astype(object) if (scores == -(1 << 63)).any() else -scores))[:k]
        yield query_id, ids[found[best]], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``; by default every row whose id ``every`` divides is a query."""
    rows = stored(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.filter(F.col("id") % every == 0) if queries is None else quantised(queries, id_col, vector_col, scale)
    n = rows.count()
    blocks = max(1, -(-n // (BLOCK_ROWS * 3 // 4)))
    index = stored(build_index(rows, blocks), "index")
    asked_n, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    # a stated query set meets every block once, in chunks: memory holds one block and one chunk.  Few blocks
    # are searched by as many chunks as there are cores; many move once for each CHUNK_BYTES of queries.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-asked_n * 8 * (wide or 1) // CHUNK_BYTES), min(-(-2 * cores // blocks), asked_n))
    sent = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    bodies = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(asked_here: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if asked_here.num_rows and block.num_rows:
            values = [np.asarray(v.values, np.int64) for v in asked_here.column("v")]
            for q, ids, scores in search_block(block.to_pylist()[0], asked_here.column("id").to_pylist(), values, k):
                found.append(pa.table([pa.array(np.full(len(ids), q, np.int64)), pa.array(ids), pa.array(scores)], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    met = sent.groupBy("block", "chunk").cogroup(bodies.groupBy("block", "chunk"))
    found = met.applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

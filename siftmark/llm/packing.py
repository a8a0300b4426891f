"""Operator 8: best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity``; pieces are dealt to
partitions, each packed best-fit-decreasing.  Dual-feasible functions give a lower
bound on the bins a partition needs: where it equals the bins used, the partition is
certified.  Open bins of partitions with a gap, and the loosest bin of every certified
one, return their documents to a pool that is dealt anew, to as many partitions
as its size asks for, and packed again.  Rounds end when a bound on the whole table is met,
when the pool fits one partition and that is packed, or when a round saves no bin.

Defined results: null text is empty (its only id is the end id); an empty table gives
no rows; rows that repeat are packed as often as they occur, and dealt apart; a null
doc_id is kept.  Ids are those of the whole text, for any file of the tokenizers library.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of a worker's word cache; it is emptied when full, so memory is bounded.
CACHE_WORDS = 1_200_000
#: ASCII signs but the apostrophe, which starts contractions, and < and |, which special tokens hold.
CLOSING = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"
# The text handling of a tokenizer that drops white space, makes lower case and keeps letters, digits and signs apart.
BLANK_SPLIT = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_blanks(tokenizer_json: str) -> bool:
    """Whether the tokenizer is of the kind whose ids of a text are those of its blank-separated chunks."""
    t = json.loads(tokenizer_json)
    parts = ((t.get("normalizer") or {}).get("normalizers"), (t.get("pre_tokenizer") or {}).get("pretokenizers"))
    added = t.get("added_tokens") or []
    whole = all(x["special"] and x["content"][:2] == "<|" and not any(x[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and " " not in x["content"] for x in added)
    return parts == (BLANK_SPLIT["normalizer"], BLANK_SPLIT["pretokenizers"]) and bool(added) and whole and not (t.get("truncation") or t.get("padding"))


class WholeIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class WordIds(dict):
    """Text chunk -> its ids as little-endian 32-bit bytes; misses go to the tokenizer.

    The tokenizer drops white space and never merges across it, so the ids of a text
    are those of its blank-separated chunks, one after another.
    """

    def __init__(self, tokenizer, most: int = CACHE_WORDS):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.mark = next(t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special)
        self.mark_id = tokenizer.token_to_id(self.mark)
        self.todo: set[str] = set()

    def __missing__(self, chunk: str) -> None:
        self.todo.add(chunk)

    def learn(self) -> None:
        """Add the ids of the chunks that were missed."""
        plain, odd, bases = [], [], []
        for c in self.todo:
            if c.isalpha():
                if c.isascii() and not c.islower():
                    bases.append((c, c.lower(), ""))
                else:
                    plain.append(c)
            elif self.mark[:2] in c:
                odd.append(c)
            else:
                base = c.rstrip(CLOSING)
                # a run of signs after a Latin letter is a piece of its own; the lower case of U+0130 ends in a mark, which joins the signs
                if base and base != c and base[-1].isalpha() and base[-1] < "\u0250" and base[-1] != "\u0130":
                    bases.append((c, base.lower() if base.isascii() else base, c[len(base) :]))
                else:
                    plain.append(c)
        self.todo = set()
        more = {x for _, *pair in bases for x in pair if x not in self}
        plain = list(more.union(plain))
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            # one call for many chunks: a special token, which no plain chunk holds, keeps them apart
            [e] = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)
            ids = np.asarray(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            raw, cuts = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
            for chunk, (a, b) in zip(part, pairwise(cuts), strict=True):
                self[chunk] = raw[a + 4 : b]
        for chunk in odd:
            self[chunk] = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        for chunk, base, signs in bases:
            self[chunk] = self[base] + self[signs]

    def ids(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(self.__getitem__, chunks))
        if self.todo:
            if len(self) > self.most:
                self.clear()
                self.todo = set(chunks)
            self.learn()
            found = map(self.__getitem__, chunks)
        return b"".join(found)


def worker_words(tokenizer_file: str, cache_words: int = CACHE_WORDS) -> WordIds | WholeIds:
    """The tokenizer of this Python worker, and its cache: it outlives a task, and stays within ``cache_words``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make() -> WordIds | WholeIds:
        with open(tokenizer_file, encoding="utf-8") as f:
            known = splits_at_blanks(f.read())
        tokenizer = Tokenizer.from_file(tokenizer_file)
        return WordIds(tokenizer, cache_words) if known else WholeIds(tokenizer)

    return worker_cache(f"ids {tokenizer_file} {cache_words}", make)


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and end id, and ``row``, a number of its own."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer_file, cache_words)
        end, seen = np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), seen))
                    seen += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), f"{PIECES}, row long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item, longest first into the bin with the least room that still fits.

    Bins wait on a stack for each remaining room; a bit set over rooms finds the
    tightest one by arithmetic on one integer.
    """
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in order.tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            chosen = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, chosen, bins = capacity, bins, bins + 1
        where[i] = chosen
        if room > need:
            waiting[room - need].append(chosen)
            rooms |= 1 << (room - need)
    return where, bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return counts_bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def counts_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest of several dual-feasible-function bounds on the bins needed; ``counts`` has the items of each length.

    f0: the plain sum.  f1 for each cut e <= capacity/2: items over capacity - e
    count as a whole bin, items under e as nothing.  f2 for k: the rounding
    function floor((k+1) x / C) / k, with exact multiples kept.
    """
    counts = counts.astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    total = np.concatenate(([0], np.cumsum(counts * sizes)))
    number = np.concatenate(([0], np.cumsum(counts)))
    e = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e + 1]
    kept = total[capacity - e + 1] - total[e]
    best = max(best, int((whole + -(-kept // capacity)).max()))
    for k in range(1, 50):
        up = (k + 1) * sizes
        f = np.where(up % capacity == 0, sizes * k, (up // capacity) * capacity)
        best = max(best, -(-int((counts * f).sum()) // (capacity * k)))
    return best


def _packed(groups, capacity: int, level: int) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        where, bins = best_fit_decreasing(lengths, capacity)
        need = lower_bound(lengths, capacity)
        fill = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        by_bin = np.lexsort((-lengths, where))
        starts = np.concatenate(([0], np.cumsum(lengths[by_bin])))[:-1]
        first = np.searchsorted(where[by_bin], np.arange(bins))
        offset = np.empty(len(lengths), np.int64)
        offset[by_bin] = starts - starts[first][where[by_bin]]
        reopened = np.zeros(bins, bool)
        if bins > need:
            reopened = fill < capacity
        else:
            reopened[np.argmin(fill)] = fill.min() < capacity
        part = table.column("part").to_numpy().astype(np.int64)
        every = lambda x: np.full(len(where), x, np.int64)
        return pa.table({
            **{c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")},
            "sequence_id": (np.int64(level) << 56) | (part << 32) | where, "offset": offset,
            "reopened": reopened[where], "part": part, "bins": every(bins), "bound": every(need), "open_bins": every(reopened.sum()),
        })

    return groups.applyInArrow(pack, PIECES + ", row long, sequence_id long, offset long, reopened boolean, part long, bins long, bound long, open_bins long")


def partitions_for(pieces: int, per_partition: int) -> int:
    """Partitions that pieces are dealt to by chance, so that none is to exceed ``per_partition``: six deviations are left free."""
    room = max(1, per_partition - int(6 * math.sqrt(per_partition)))
    return max(1, -(-pieces // room)) if pieces > per_partition else 1


def pack_pieces(pieces: DataFrame, capacity: int = 4096, per_partition: int = 60_000, max_rounds: int = 12) -> DataFrame:
    """Give each piece a ``sequence_id`` and ``offset``; ``pieces`` must be stored, as rounds read it again.

    ``per_partition`` bounds the pieces one task packs (some 60 bytes each), in every round.
    """
    if "row" not in pieces.columns:
        pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "numbered")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # a row a length, ``capacity`` at most
        counts[r["length"]] = r["count"]
    bound, parts = counts_bound(counts, capacity), partitions_for(int(counts.sum()), per_partition)
    done, closed, pool, kept, level = [], 0, pieces, None, 0
    while True:
        # by the row's own number: rows of one id, or of one text, are dealt apart
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(parts)).cast("int"))
        packed = stored(_packed(dealt.groupBy("part"), capacity, level), f"packed{level}")
        each = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("open_bins").alias("open_bins"), F.count_if("reopened").alias("left"))
        bins, open_bins, left = (x or 0 for x in each.agg(F.sum("bins"), F.sum("open_bins"), F.sum("left")).first())
        if kept is not None and bins >= before:
            return _union([*done, kept])
        if parts == 1 or level == max_rounds or not left or closed + bins <= bound:
            return _union([*done, packed])
        done.append(packed.filter("not reopened"))
        closed += bins - open_bins
        kept, before = packed.filter("reopened"), open_bins
        pool, level, parts = kept.select(*pieces.columns), level + 1, partitions_for(left, per_partition)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.drop("row", "reopened", "part", "bins", "bound", "open_bins")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents, each with its sequence and its gapless place there; a worker remembers the ids of ``cache_words`` words."""
    return pack_pieces(stored(tokenized_pieces(docs, tokenizer_file, capacity, end_id, cache_words), "pieces"), capacity)


__all__ = ["best_fit_decreasing", "lower_bound", "pack_documents", "pack_pieces", "tokenized_pieces"]

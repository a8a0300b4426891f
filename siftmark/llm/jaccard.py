"""Operator 9: exact n-gram Jaccard join by parity sketches, and the components of its links.

A text's tokens are its distinct word shingles.  Every token toggles one bit of a wide bit
sketch, so the Hamming distance of two sketches never exceeds the symmetric difference of
the sets; for a Jaccard similarity of J that difference is at most (a + b)(1 - J)/(1 + J).
Within a band of set sizes the sketch is cut into more pieces than that bound (and a
few to spare for pieces without tokens): two similar sets agree on a piece both fill.
A piece travels as one 64-bit fingerprint of its parities.

1. Equal sets become one class; from here on only distinct sets count.
2. Classes meet by piece fingerprint.  In each of a few rounds every bucket draws one of its
   classes and compares the others with that one only, so g classes give g - 1 candidates:
   first the Hamming distance of their sketches, then their whole sets.  Linked classes
   become components, and buckets that lie within one component are done.  Fingerprints
   that very many classes hold are told by a sample and dealt to salts: each salt
   draws a class, and one of those is drawn for all.
3. Buckets whose classes still lie in several components have all their cross-component
   pairs compared, sketches in blocks first.  No pair within the threshold escapes: it
   shares a bucket, and is tested unless already linked through others.

Sets of tokens, classes and pieces are told apart by 64-bit hashes.

Defined results: null, empty and blank texts have no tokens, link with nothing and are
components of their own; fewer words than a shingle count as one token; a null doc_id is
linked like any other, but never names a component (a component of null ids is null);
rows that repeat share a component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_PARTS, components, discard, lookup, stored, tidy, worker_cache

CACHE_WORDS = 100_000
#: Classes whose pieces a task remembers as sent; forgetting only costs repeats.
SENT_CLASSES = 50_000
#: Bits at least of the sketch that candidate pairs are held against before their sets are.
LEAST_BITS = 512
#: Classes of a bucket that names its pairs; rows of a larger one that are compared as one block.
SMALL_BUCKET = 8
#: Buckets that a class lists, the smallest keys of its large ones, so that a pair is named by few of those it shares.
FIRST_KEYS = 12
#: Bytes of sketches that are compared as one block, about.
BLOCK_BYTES = 1 << 20
#: One text in SAMPLE tells which fingerprints are hot: SAMPLED classes of it at least, or a 2048th of all its pieces.
SAMPLE, SAMPLED = 64, 256
#: Classes of a hot fingerprint that a salt holds, about.
SALT_CLASSES = 8192
#: Rows of one id and text from which on they may count as many.
HOT_COPIES = 64
#: Ids and sizes of classes are broadcast up to this many (some 10 MB), else joined by a shuffle.
BROADCAST_CLASSES = 300_000
#: Rounds at most in which a bucket draws a class before all that is left is compared, and orders of the first.
ROUNDS, FIRST_ORDERS = 7, 4
#: Ratio between the largest sizes of neighbouring bands.
BAND_RATIO = 1.6
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, vectorised; wraps."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct shingle hashes of a text, ascending."""

    def __init__(self, words: int):
        self.words, self.known = words, worker_cache("words", WordHashes)
        self.odd = mix(np.arange(1, words + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def tokens(self, text: bytes | None) -> np.ndarray:
        words = text.translate(LOWER).split() if text else []  # bytes split at exactly \x20 and \x09-\x0d
        if not words:
            return np.empty(0, U64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), U64, len(words))
        k = min(self.words, len(words))
        total = np.zeros(len(words) - k + 1, U64)
        for j in range(k):
            total += h[j : len(words) - k + 1 + j] * self.odd[j]
        if k < self.words:
            total += U64(k)
        return np.unique(mix(total))


def set_id(tokens: np.ndarray) -> int:
    """64-bit identity of a token set, as a signed long."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


class Bands:
    """Size bands and the pieces that sets of each band are cut into."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [8]
        while self.tops[-1] < 1 << 40:
            self.tops.append(int(self.tops[-1] * BAND_RATIO) + 1)

    def bound(self, both: int) -> int:
        """Most tokens two linked sets of ``both`` tokens together differ by."""
        return both * (self.den - self.num) // (self.den + self.num)

    def pieces(self, band: int) -> int:
        return self.bound(2 * self.tops[band]) + 3 + self.tops[band] // 200

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, bound) of each band in which a set of n tokens may meet a partner that differs."""
        largest = n * self.den // self.num
        band = int(np.searchsorted(self.tops, n))
        found = []
        while band == 0 or self.tops[band - 1] < largest:
            bound = self.bound(n + min(largest, self.tops[band]))
            if bound:
                found.append((band, bound))
            band += 1
        return found


def piece_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Fingerprints of the pieces of a set, in each of its bands."""
    out = []
    spread = mix(tokens + U64(0x632BE59BD9B4E019))
    for band, bound in bands.of(len(tokens)):
        m = bands.pieces(band)
        piece = (spread >> U64(32)) % U64(m)
        order = np.argsort(piece)
        piece = piece[order]
        first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        parity = np.bitwise_xor.reduceat(spread[order], first)
        name = mix(piece[first] + U64(band << 40) + U64(1))
        out.append(mix(parity ^ name))
        if m - bound <= m - len(first):
            # so many pieces are empty that two such sets may agree on those alone
            empty = np.setdiff1d(np.arange(m, dtype=U64), piece[first])
            out.append(mix(mix(empty + U64(band << 40) + U64(1)) ^ U64(0xA5A5A5A5A5A5A5A5)))
    return np.concatenate(out) if out else np.empty(0, U64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of bits that tokens toggle, as longs: a power of two of bits, LEAST_BITS and twice the tokens at least."""
    bits = max(LEAST_BITS, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> U64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(longs: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits from one of more: its parts, added bit by bit."""
    return np.bitwise_xor.reduce(longs.reshape(-1, size), axis=0)


def _text(cell) -> bytes | None:
    return cell.as_buffer().to_pybytes() if cell.is_valid else None


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_id"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_id, n, class`` of every document; a row's text is found again by doc_id and text_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.tokens(_text(t)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], names=["doc_id", "text_id", "n", "class"]
            )

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, text_id long, n long, class long")


def _keys(docs: DataFrame, words: int, bands: Bands, hot: dict[int, int]) -> DataFrame:
    """``key, salt, class``: the pieces of each class, sent once a task; the salt is -1 but for the keys in ``hot``, which have that many."""
    hot_keys = np.array(sorted(hot), np.int64)
    salts = np.array([hot[k] for k in sorted(hot)], np.int64)

    def salted(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        keys, salt = keys.view(np.int64), np.full(len(keys), -1, np.int64)
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
            found = np.flatnonzero(hot_keys[at] == keys)
            salt[found] = (mix(ids[found].view(U64)) % salts[at[found]].astype(U64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salt), pa.array(ids)], names=["key", "salt", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(words), set()
        for batch in batches:
            keys, ids, held = [], [], 0
            for cell in batch.column(0):
                tokens = shingler.tokens(_text(cell))
                ident = set_id(tokens)
                if ident in sent or not len(tokens):
                    continue
                if len(sent) >= SENT_CLASSES:
                    sent.clear()
                sent.add(ident)
                found = piece_keys(tokens, bands)
                keys.append(found)
                ids.append(np.full(len(found), ident, np.int64))
                held += len(found)
                if held > 200_000:
                    yield salted(np.concatenate(keys), np.concatenate(ids))
                    keys, ids, held = [], [], 0
            if held:
                yield salted(np.concatenate(keys), np.concatenate(ids))

    return docs.select("text").mapInArrow(tidy(run), "key long, salt long, class long")


def _hot_keys(docs: DataFrame, words: int, bands: Bands) -> dict[int, int]:
    """Fingerprints that very many classes hold, with the salts they are dealt to; it matters to speed alone.

    At most 2048 reach their share of all pieces of the sample, so the driver holds no more.
    """
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = stored(_keys(sample, words, bands, {}).distinct().groupBy("key").count(), "sampled")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return {r["key"]: max(2, -(-r["count"] * SAMPLE // SALT_CLASSES)) for r in counts.filter(F.col("count") >= max(SAMPLED, -(-total // 2048))).collect()}


def _token_table(docs: DataFrame, wanted: DataFrame, words: int, count: int) -> DataFrame:
    """``class, n, sketch, tokens`` of the classes in ``wanted(doc_id, text_id, class)``, once a task."""
    few = F.broadcast(wanted) if count <= BROADCAST_CLASSES else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(words), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                made: list[tuple[int, np.ndarray]] = []
                for ident, cell in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                    if ident in sent:
                        continue
                    tokens = shingler.tokens(_text(cell))
                    # two texts may share a text_id: only the class asked for counts
                    if set_id(tokens) == ident:
                        sent.add(ident)
                        made.append((ident, tokens))
                if len(sent) >= SENT_CLASSES:
                    sent.clear()
                if made:
                    sketches = [sketch(t) for _, t in made]
                    ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i for i, _ in made], pa.int64()), pa.array([len(t) for _, t in made], pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sketches))), pa.array([t.tobytes() for _, t in made], pa.binary()),
                    ], names=["class", "n", "sketch", "tokens"])

    texts = _texts(docs)
    # by both: ids may be null or repeat with other texts, and copies of a text are many
    rows = texts.join(few, texts["doc_id"].eqNullSafe(few["doc_id"]) & (texts["text_id"] == few["text_id"])).select("class", "text")
    return rows.mapInArrow(tidy(run), "class long, n long, sketch array<long>, tokens binary")


def _near(pairs: DataFrame, sizes: DataFrame, tokens: DataFrame, bands: Bands, few: bool) -> DataFrame:
    """Distinct pairs ``a, b`` whose sizes, then sketches, allow a link."""
    num, den = bands.num, bands.den
    known = F.broadcast(sizes) if few else sizes
    sketches = tokens.select("class", "sketch").dropDuplicates(["class"])
    met = pairs.join(known.toDF("a", "n_a"), "a").join(known.toDF("b", "n_b"), "b")
    met = met.filter(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").distinct()
    met = met.join(sketches.toDF("a", "s_a"), "a").join(sketches.toDF("b", "s_b"), "b")
    none = F.lit(0).cast("long")
    size = F.least(F.size("s_a"), F.size("s_b"))

    def fold(x: str):  # the longer sketch at the shorter one's size
        parts = F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1)
        word = lambda i: F.aggregate(parts, none, lambda t, k: t.bitwiseXOR(F.get(x, i + k * size)))
        return F.when(F.size(x) == size, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), size - 1), word))

    apart = F.aggregate(F.zip_with(fold("s_a"), fold("s_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), none, lambda t, x: t + x)
    return met.filter(apart * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b")


def _verified(pairs: DataFrame, tokens: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``a, b`` whose whole sets meet the threshold."""
    num, den = bands.num, bands.den
    used = stored(pairs.select("a").union(pairs.select("b")).distinct().toDF("class"), "used")
    few = F.broadcast(used) if used.count() <= BROADCAST_CLASSES else used
    sets = tokens.join(few, "class", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _pairs_in_runs(rows: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of different components among the few rows of each key; rows come sorted by key, class."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, np.int64)] * 3
        for batch in batches:
            key, ident, comp = (np.concatenate([t, batch.column(c).to_numpy()]) for t, c in zip(tail, ("key", "class", "comp"), strict=True))
            a, b = [], []
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            for step in range(1, SMALL_BUCKET):
                # a row meets the rows up to SMALL_BUCKET - 1 places on; the kept tail holds the open run
                same = np.flatnonzero((key[step:last] == key[: max(0, last - step)]) & (comp[step:last] != comp[: max(0, last - step)]))
                a.append(ident[same])
                b.append(ident[same + step])
            tail = [key[last:], ident[last:], comp[last:]]
            if any(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        key, ident, comp = tail
        i, j = np.triu_indices(len(key), 1)
        open_ = comp[i] != comp[j]
        if open_.any():
            yield pa.RecordBatch.from_arrays([pa.array(ident[i[open_]]), pa.array(ident[j[open_]])], names=["a", "b"])

    return rows.mapInArrow(tidy(pairs), "a long, b long")


def _near_in_blocks(rows: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of rows with one (key, i, j), of different components, whose sketches lie within the bound."""

    def compare(table: pa.Table, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ident, comp = table.column("class").to_numpy(), table.column("comp").to_numpy()
        n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
        i, j, key = (table.column(c).to_numpy() for c in ("i", "j", "key"))
        firsts = table.column("firsts").combine_chunks()
        lists = np.full((len(ident), FIRST_KEYS), np.iinfo(np.int64).max)
        counts = firsts.value_lengths().to_numpy()
        lists[np.arange(FIRST_KEYS) < counts[:, None]] = firsts.flatten().to_numpy()
        sketches = table.column("sketch").combine_chunks()
        flat, cuts = sketches.flatten().to_numpy().view(U64), np.concatenate(([0], np.cumsum(sketches.value_lengths().to_numpy())))
        a, b = [], []
        for start, end in zip(ends, ends[1:], strict=False):
            size = int((cuts[start + 1 : end + 1] - cuts[start:end]).min())
            bits = np.stack([folded(flat[cuts[r] : cuts[r + 1]], size) for r in range(start, end)])
            left = np.arange(start, end)
            right = left
            if i[start] != j[start]:
                left, right = left[block[start:end] == i[start]], right[block[start:end] == j[start]]
            strip = max(1, min(256, 250_000 // len(right)))  # some 10 MB of numbers at once
            for at in range(0, len(left), strip):
                x = left[at : at + strip]
                open_ = comp[x][:, None] != comp[right][None, :]
                small, large = np.minimum(n[x][:, None], n[right][None, :]), np.maximum(n[x][:, None], n[right][None, :])
                open_ &= bands.den * small >= bands.num * large
                if i[start] == j[start]:
                    open_ &= ident[x][:, None] < ident[right][None, :]
                p, q = np.nonzero(open_)
                if len(p):
                    p, q = x[p], right[q]
                    most = max(1, min(20_000, 500_000 // size))  # sketches of long texts are long: 4 MB at once
                    for cut in range(0, len(p), most):
                        pp, qq = p[cut : cut + most], q[cut : cut + most]
                        apart = np.bitwise_count(bits[pp - start] ^ bits[qq - start]).sum(1, dtype=np.int64)
                        ok = apart * (bands.den + bands.num) <= (n[pp] + n[qq]) * (bands.den - bands.num)
                        pp, qq = pp[ok], qq[ok]
                        if len(pp):  # a smaller bucket that both list is the one to name them
                            x_keys = np.where(lists[pp] < key[start], lists[pp], -1)
                            again = ((x_keys[:, :, None] == lists[qq][:, None, :]) & (x_keys[:, :, None] != -1)).any(axis=(1, 2))
                            a.append(ident[pp[~again]])
                            b.append(ident[qq[~again]])
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table])
            marks = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for m in marks:
                new[1:] |= m[1:] != m[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:  # the last run may go on in the next batch
                a, b = compare(table, starts)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            left = table.slice(starts[-1]) if len(starts) else left
        if left is not None and left.num_rows:
            a, b = compare(left, np.array([0, left.num_rows]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _linked(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The stored ``doc_id, text_id, n, class`` of every document, and ``class, docs, comp, component_id`` of every class with tokens."""
    bands = Bands(num, den)
    sets = stored(_sets(docs, words), "sets")
    classes = sets.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_id", "doc_id"), F.min("text_id")).alias("rep_text"), F.count("*").alias("docs"))
    classes = stored(classes, "classes")

    # buckets of two classes or more, with a class drawn for each
    # a few orders of the classes at first: most groups fall into one component by few comparisons
    draw = F.xxhash64("class", F.pmod("key", F.lit(FIRST_ORDERS)))
    by = Window.partitionBy("key", "salt").orderBy("draw", "class")
    keys = _keys(docs, words, bands, _hot_keys(docs, words, bands)).repartition("key", "salt").withColumn("draw", draw)
    met = keys.select("key", "salt", "class", F.first("class").over(by).alias("first"), F.lag("class").over(by).alias("before"))
    met = stored(met.filter("class <> first and class <> before or salt >= 0 and before is null").select("key", "first", "class"), "met")
    # a salt's own class was kept: it meets the one drawn among all salts
    heads = met.filter("class = first").select("key", "class").withColumn("first", F.first("class").over(Window.partitionBy("key").orderBy(draw, "class")))
    buckets = met.filter("class <> first").unionByName(heads.filter("class <> first"))
    seen = buckets.select("class").union(buckets.select("first")).distinct()
    wanted = stored(seen.join(classes, "class").select(F.col("rep").alias("doc_id"), F.col("rep_text").alias("text_id"), "class", "n"), "wanted")
    count = wanted.count()
    tokens = stored(_token_table(docs, wanted.select("doc_id", "text_id", "class"), words, count), "tokens")
    sizes, few = wanted.select("class", "n"), count <= BROADCAST_CLASSES
    vertices = wanted.select(F.col("class").alias("id"))

    def linked_by(pairs: DataFrame, name: str) -> DataFrame:
        near = stored(_near(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sizes, tokens, bands, few), f"near_{name}")
        out = stored(_verified(near, tokens, bands), name)
        discard(near)
        return out

    links = linked_by(buckets.select(F.col("first").alias("a"), F.col("class").alias("b")), "links0")
    comp = components(vertices, links)
    members = buckets.select("key", "class").union(buckets.select("key", F.col("first").alias("class"))).distinct()
    rest = None
    for turn in range(1, ROUNDS + 1):
        # what is left: buckets that hold several components; a bucket's draw is an aggregate, so no task holds it whole
        labels = comp.toDF("class", "comp")
        held = members.select("key", "class").join(F.broadcast(labels) if few else labels, "class")
        drawn = held.groupBy("key").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("g"),
            F.min(F.struct(F.xxhash64("class", "key", F.lit(turn)).alias("draw"), "class", "comp")).alias("first"),
        )
        drawn = stored(drawn.filter("low <> high").select("key", "g", F.col("first.class").alias("first"), F.col("first.comp").alias("first_comp")), "drawn")
        last, members = members, stored(held.join(drawn, "key").select("key", "class", "comp", "g", "first", "first_comp"), "members")
        discard(last)
        rest, before = members.select("comp").distinct().count(), rest
        if turn == ROUNDS or not rest or before is not None and rest > 0.98 * before:
            break  # more draws would hardly join more
        pairs = members.filter("comp <> first_comp").select(F.col("first").alias("a"), F.col("class").alias("b"))
        links = links.union(linked_by(pairs, f"links{turn}"))
        comp = components(vertices, links)

    # small buckets name their pairs, which then meet the sketches; large ones bring the sketches along
    tiny = members.filter(F.col("g") <= SMALL_BUCKET).select("key", "class", "comp").repartition("key").sortWithinPartitions("key", "class")
    named_pairs = _near(_pairs_in_runs(tiny), sizes, tokens, bands, few)
    known = tokens.select("class", "n", "sketch").dropDuplicates(["class"])
    rows = members.filter(F.col("g") > SMALL_BUCKET).select("key", "class", "comp")
    weight = rows.join(F.broadcast(sizes) if few else sizes, "class").groupBy("key").agg(F.sum(F.greatest(F.lit(64), F.col("n") / 2)).alias("bytes"))
    weight = stored(weight.select("key", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("k")), "weights")
    rows = rows.join(weight, "key").withColumn("block", F.pmod(F.hash("class"), F.col("k")))
    firsts = rows.groupBy("class").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    known = known.join(firsts, "class")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("key", "class", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(known, "class").select("key", "class", "comp", "n", "sketch", "firsts", "block", "i", "j")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class")
    more = stored(_near_in_blocks(rows, bands).union(named_pairs).distinct(), "more")
    late = stored(_verified(more, tokens, bands), "late")
    if late.limit(1).count():
        comp = components(vertices, links.union(late))
    for table in (met, tokens, members, more):
        discard(table)

    named = classes.join(comp.withColumnRenamed("id", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return sets, stored(named.join(names, "comp").select("class", "docs", "comp", "component_id"), "named")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; links need ``den * both >= num * either``."""
    sets, table = _linked(docs, words, num, den)
    table, total = table.select("class", "docs", "component_id"), sets.count()
    linked = lookup(sets.filter("n > 0"), table, "class", "docs", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, a null one where all are null.

    Rows without tokens link with nothing: one of each doc_id stays, and all with a null id.
    """
    sets, table = _linked(docs, words, num, den)
    # a row of each class, then of each component: the group of a hot class shrinks where it is read
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    firsts = sets.filter("n > 0").groupBy("class").agg(F.min(place).alias("place"))
    firsts = firsts.join(table.select("class", "comp"), "class").groupBy("comp").agg(F.min("place").alias("place"))
    blank = sets.filter("n = 0 and doc_id is not null").groupBy("doc_id").agg(F.min("text_id").alias("text_id"))
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id")]
    by = ["_none", "_id", "_text"]
    keep = stored(firsts.select("place.doc_id", "place.text_id").unionByName(blank).select(*key, F.col("text_id").alias("_text")), "keep")
    # rows that repeat id and text are one; those of very many rows are told apart, 2048 of them at most
    least = max(HOT_COPIES, sets.count() // HOT_PARTS)
    hot = stored(sets.groupBy(*key, F.col("text_id").alias("_text")).count().filter(F.col("count") >= least).drop("count"), "hot")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, F.xxhash64("text").alias("_text"))  # names of docs can't clash
    same = F.xxhash64("row")
    some = hot.limit(1).count()
    cold = rows.join(F.broadcast(hot), by, "left_anti") if some else rows
    out = cold.join(keep, by, "left_semi").withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(same))).filter("at = 1").select("row.*")
    if some:  # a row of each task, then one of all
        known = F.broadcast(hot.join(keep, by, "left_semi"))
        out = out.unionByName(rows.join(known, by, "left_semi").groupBy(*by).agg(F.min_by("row", same).alias("row")).select("row.*"))
    known = stored(sets.filter("n = 0 and doc_id is null").select(F.col("text_id").alias("_text")).distinct(), "blank")
    return out.unionByName(rows.filter("_none").join(known, "_text", "left_semi").select("row.*"))

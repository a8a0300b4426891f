"""Bottom-k MinHash sketches and context-triggered piecewise digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp_percent, kernel, metrics, percent_text, whole_text, with_error
from ..functions.kernels import bottom_k, ctph_digest
from ..options import CompareOptions
from ..sources.images import both_sides


def sketches(images: DataFrame, opts: CompareOptions, errors: bool = False) -> DataFrame:
    """``image_id, size, sketch, digest``; hashes are 16 hex digits, whose order is the unsigned one."""
    k, size = opts.shingle, opts.sketch

    def each(data: bytes):
        raw = bottom_k(data, k, size).astype(">u8").tobytes().hex()
        return [(len(data), [raw[i : i + 16] for i in range(0, len(raw), 16)], ctph_digest(data))]

    return kernel(images, each, {"size": pa.int64(), "sketch": pa.list_(pa.string()), "digest": pa.string()}, "size long, sketch array<string>, digest string", errors)


def minhash_sketches(images: DataFrame, opts: CompareOptions, errors: bool = False) -> DataFrame:
    """``image_id, size, sketch`` without the digests."""
    k, size = opts.shingle, opts.sketch

    def each(data: bytes):
        raw = bottom_k(data, k, size).astype(">u8").tobytes().hex()
        return [(len(data), [raw[i : i + 16] for i in range(0, len(raw), 16)])]

    return kernel(images, each, {"size": pa.int64(), "sketch": pa.list_(pa.string())}, "size long, sketch array<string>", errors)


def digests(images: DataFrame, errors: bool = False) -> DataFrame:
    """``image_id, size, digest`` without the sketches."""
    return kernel(images, lambda data: [(len(data), ctph_digest(data))], {"size": pa.int64(), "digest": pa.string()}, "size long, digest string", errors)


def sketch_rows(images: DataFrame, opts: CompareOptions) -> DataFrame:
    """``image_id, hash`` of every sketch."""
    return minhash_sketches(images, opts).select("image_id", F.explode("sketch").alias("hash"))


def sketch_jaccard(a: Column, b: Column, size: int) -> Column:
    """Of the ``size`` smallest hashes of the union, the part that both hold; 1 where both are empty."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def _edit_percent(x: Column, y: Column) -> Column:
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 100.0).otherwise(clamp_percent((1 - F.levenshtein(x, y) / longest) * 100))


def digest_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of the digests' parts of one block size; 0 where none is shared or a digest can't be read."""
    pa_, pb_ = F.split(a, ":"), F.split(b, ":")
    size = lambda p: F.when(F.size(p) == 3, p[0].try_cast("long"))
    sa, sb = size(pa_), size(pb_)
    return F.coalesce(
        F.when(sa == sb, _edit_percent(pa_[1], pb_[1])).when(sa == 2 * sb, _edit_percent(pa_[1], pb_[2])).when(sb == 2 * sa, _edit_percent(pa_[2], pb_[1])),
        F.lit(0.0),
    )


def block_size(size: Column) -> Column:
    """3 times the largest power of two up to size / 64 + 1, in whole numbers."""
    return F.lit(3).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.floor(size / 64) + 1)) - 1)


def _by_size(score: Column) -> Column:
    """100 where both payloads are empty, 0 where one is."""
    empty_a, empty_b = F.col("a.size") == 0, F.col("b.size") == 0
    return F.when(empty_a & empty_b, 100.0).when(empty_a | empty_b, 0.0).otherwise(score)


def minhash_percent(size: int) -> Column:
    """The sketch similarity of the sides ``a`` and ``b``."""
    return _by_size(clamp_percent(100 * sketch_jaccard(F.col("a.sketch"), F.col("b.sketch"), size)))


def ctph_percent() -> Column:
    """The digest similarity of the sides ``a`` and ``b``."""
    return _by_size(digest_similarity(F.col("a.digest"), F.col("b.digest")))


def compare(sides: DataFrame, opts: CompareOptions) -> DataFrame:
    """``pair_id, minhash_percent, ctph_percent, digest_a, digest_b, error`` from both sides' sketches."""
    error = F.coalesce("a.error", "b.error") if "error" in sides.schema["a"].dataType.names else F.lit(None).cast("string")
    return sides.select(
        "pair_id", minhash_percent(opts.sketch).alias("minhash_percent"), ctph_percent().alias("ctph_percent"),
        F.col("a.digest").alias("digest_a"), F.col("b.digest").alias("digest_b"), error.alias("error"),
    )


def score_of(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    """``pair_id, similarity_percent`` alone: no digests."""
    sides = both_sides(pairs, minhash_sketches(images, opts, errors=True))
    s = sides.select("pair_id", minhash_percent(opts.sketch).alias("similarity_percent"), F.coalesce("a.error", "b.error").alias("error"))
    return with_error(s, F.col("error"))


def section(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    s = compare(both_sides(pairs, sketches(images, opts, errors=True)), opts)
    k = F.lit(opts.shingle).cast("int")
    s = s.select(
        "pair_id", "error", F.col("minhash_percent").alias("similarity_percent"), "minhash_percent", "ctph_percent", k.alias("shingle_k"), "digest_a", "digest_b",
        metrics(
            ("MinHash similarity", percent_text(F.col("minhash_percent"))), ("CTPH similarity", percent_text(F.col("ctph_percent"))), ("Shingle-k", whole_text(k)),
            ("CTPH-Digest A", F.col("digest_a")), ("CTPH-Digest B", F.col("digest_b")),
        ).alias("metrics"),
    )
    return with_error(s, F.col("error"))

"""Shared and unique content-defined chunks, and byte-histogram cosine."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clamp_percent, exact_percent_text, histogram_cosine, kernel, metrics, whole_text, with_error
from ..functions.kernels import chunk_lengths, histogram
from ..options import CompareOptions
from ..sources.images import both_sides


def chunks(images: DataFrame, opts: CompareOptions, errors: bool = False) -> DataFrame:
    """``image_id, offset, length, chunk_key`` in file order; the key is the chunk's SHA-256.  With ``errors`` see :func:`kernel`."""
    least, most, mask = opts.cdc

    def each(data: bytes):
        at = 0
        for n in chunk_lengths(data, least, most, mask):
            yield at, n, hashlib.sha256(data[at : at + n]).hexdigest()
            at += n

    return kernel(images, each, {"offset": pa.int64(), "length": pa.int32(), "chunk_key": pa.string()}, "offset long, length int, chunk_key string", errors)


def histograms(images: DataFrame, errors: bool = False) -> DataFrame:
    """``image_id, size, bins``: 256 counts."""
    return kernel(images, lambda data: [(len(data), histogram(data).tolist())], {"size": pa.int64(), "bins": pa.list_(pa.int64())}, "size long, bins array<long>", errors)


def byte_counts(images: DataFrame) -> DataFrame:
    """``image_id, byte, cnt`` of the bytes that occur."""
    bins = histograms(images).select("image_id", F.posexplode("bins").alias("byte", "cnt"))
    return bins.filter("cnt > 0").select("image_id", "byte", "cnt")


def histogram_cosines(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair_id, cosine_percent``: 100 for two empty payloads, 0 where one is."""
    return cosines(both_sides(pairs, histograms(images)))


def cosines(sides: DataFrame) -> DataFrame:
    """The same from both sides' histograms; an ``error`` of either is handed on."""
    empty = (F.col("a.size") == 0) & (F.col("b.size") == 0)
    cosine = clamp_percent(100 * histogram_cosine(F.col("a.bins"), F.col("b.bins")))
    error = [F.coalesce("a.error", "b.error").alias("error")] if "error" in sides.schema["a"].dataType.names else []
    return sides.select("pair_id", F.when(empty, 100.0).otherwise(cosine).alias("cosine_percent"), *error)


def _sided(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks of both sides of every pair, one row each, marked by side."""
    a = pairs.join(found, pairs["a_id"] == found["image_id"]).select("pair_id", F.lit("a").alias("side"), *[c for c in found.columns if c != "image_id"])
    b = pairs.join(found, pairs["b_id"] == found["image_id"]).select("pair_id", F.lit("b").alias("side"), *[c for c in found.columns if c != "image_id"])
    return a.unionByName(b)


def chunk_jaccard(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of shared and unique distinct chunks, totals with repeats, and the Jaccard percentage.

    One aggregation by (pair, chunk) with a map-side part, then one by pair.  An ``error`` of a side is handed on.
    """
    error = ["error"] if "error" in found.columns else []
    first = [F.max(c).alias(c) for c in error]
    by_chunk = _sided(pairs, found).groupBy("pair_id", "chunk_key").agg(F.count_if(F.col("side") == "a").alias("in_a"), F.count_if(F.col("side") == "b").alias("in_b"), *first)
    real = F.col("chunk_key").isNotNull()  # a failed payload has none
    counted = by_chunk.groupBy("pair_id").agg(
        F.count_if(real & (F.col("in_a") > 0) & (F.col("in_b") > 0)).alias("common"),
        F.count_if(real & (F.col("in_b") == 0)).alias("only_a"), F.count_if(real & (F.col("in_a") == 0)).alias("only_b"),
        F.sum(F.when(real, F.col("in_a"))).alias("total_a"), F.sum(F.when(real, F.col("in_b"))).alias("total_b"), *first,
    )
    zero = F.lit(0).cast("long")
    filled = pairs.select("pair_id").join(counted, "pair_id", "left").select("pair_id", *[F.coalesce(c, zero).alias(c) for c in ("common", "only_a", "only_b", "total_a", "total_b")], *error)
    union = F.col("common") + F.col("only_a") + F.col("only_b")
    return filled.withColumn("jaccard_percent", F.when(union == 0, 100.0).otherwise(clamp_percent(100.0 * F.col("common") / union)))


def diff_spans(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pair_id, side, offset, length, shared`` of every chunk: shared where the other side holds it too."""
    sided = _sided(pairs, found)
    by = Window.partitionBy("pair_id", "chunk_key")
    shared = (F.max(F.col("side") == "a").over(by)) & (F.max(F.col("side") == "b").over(by))
    return sided.withColumn("shared", shared).select("pair_id", "side", "offset", "length", "shared")


def diff_maps(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pair_id, map_a, map_b``: the spans in file order."""
    spans = diff_spans(pairs, found)
    ordered = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("offset", "length", "shared"))))
    maps = spans.groupBy("pair_id").agg(ordered("a").alias("map_a"), ordered("b").alias("map_b"))
    none = F.array().cast("array<struct<offset:bigint,length:int,shared:boolean>>")
    return pairs.select("pair_id").join(maps, "pair_id", "left").select("pair_id", F.coalesce("map_a", none).alias("map_a"), F.coalesce("map_b", none).alias("map_b"))


def score_of(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    """``pair_id, similarity_percent`` alone: neither histograms nor maps are built."""
    s = chunk_jaccard(pairs, chunks(images, opts, errors=True))
    return with_error(s.select("pair_id", F.col("jaccard_percent").alias("similarity_percent"), "error"), F.col("error"))


def section(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    """The module's section: scores, counts, maps and metrics of every pair."""
    found = chunks(images, opts, errors=True)
    maps = diff_maps(pairs, found.filter("error is null").drop("error"))
    s = chunk_jaccard(pairs, found).withColumnRenamed("error", "failed").join(cosines(both_sides(pairs, histograms(images, errors=True))), "pair_id").join(maps, "pair_id")
    error = F.coalesce("failed", "error").alias("error")
    s = s.select(
        error,
        "pair_id", F.col("jaccard_percent").alias("similarity_percent"), "jaccard_percent", "cosine_percent", "common", "only_a", "only_b", "total_a", "total_b", "map_a", "map_b",
        metrics(
            ("Similarity (Jaccard)", exact_percent_text(F.col("jaccard_percent"))), ("Byte-histogram cosine", exact_percent_text(F.col("cosine_percent"))),
            ("Shared chunks", whole_text(F.col("common"))), ("Only in A", whole_text(F.col("only_a"))), ("Only in B", whole_text(F.col("only_b"))),
            ("Chunks A / B", F.concat_ws(" / ", whole_text(F.col("total_a")), whole_text(F.col("total_b")))),
        ).alias("metrics"),
    )
    return with_error(s, F.col("error"))

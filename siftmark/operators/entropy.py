"""Block entropy profiles and their similarity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp_percent, kernel, metrics, number_text, percent_text, whole_text, with_error
from ..functions.kernels import block_entropy
from ..options import CompareOptions
from ..sources.images import both_sides


def profiles(images: DataFrame, opts: CompareOptions, errors: bool = False) -> DataFrame:
    """``image_id, size, profile``: bits a byte of every block."""
    block = opts.block
    return kernel(images, lambda data: [(len(data), block_entropy(data, block).tolist())], {"size": pa.int64(), "profile": pa.list_(pa.float64())}, "size long, profile array<double>", errors)


def shannon_entropy(images: DataFrame) -> DataFrame:
    """``image_id, entropy`` of whole payloads, 0 for an empty one."""
    return kernel(images, lambda data: [(float(block_entropy(data, max(1, len(data)))[0]) if data else 0.0,)], {"entropy": pa.float64()}, "entropy double")


def block_rows(images: DataFrame, opts: CompareOptions) -> DataFrame:
    """``image_id, block, entropy`` of every block."""
    return profiles(images, opts).select("image_id", F.posexplode("profile").alias("block", "entropy"))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / F.size(x)


def profile_stats(profile: Column, threshold: float) -> dict[str, Column]:
    """Mean, maximum and share of blocks at or over the threshold; 0 for no blocks."""
    some = F.size(profile) > 0
    high = F.size(F.filter(profile, lambda v: v >= threshold)) / F.size(profile)
    return {
        "mean": F.when(some, _mean(profile)).otherwise(0.0),
        "max": F.when(some, F.array_max(profile)).otherwise(0.0),
        "high": F.when(some, high).otherwise(0.0),
    }


def resample(profile: Column, points: Column) -> Column:
    """Bucket means at ``points`` points: bucket i runs from floor(i*w) to floor((i+1)*w), w = length/points, one value at least.

    The bounds are products of a double, cut off; with more points than values starts stay inside.
    """
    n = F.size(profile)
    width = n.cast("double") / points

    def bucket(i: Column) -> Column:
        start = F.least(F.floor(i * width).cast("int"), n - 1)
        end = F.least(F.greatest(F.floor((i + 1) * width).cast("int"), start + 1), n)
        return _mean(F.slice(profile, start + 1, end - start))

    spread = F.transform(F.sequence(F.lit(0), points - 1), bucket)
    return F.when((n == points) | (n == 0) | (points <= 0), profile).otherwise(spread)


def downsample(profile: Column, most: int) -> Column:
    """The profile itself, or ``most`` bucket means of a longer one; most <= 0 keeps all."""
    if most <= 0:
        return profile
    return F.when(F.size(profile) > most, resample(profile, F.lit(most))).otherwise(profile)


def profile_similarity(a: Column, b: Column, most: int) -> Column:
    """100 less the mean distance as a share of 8 bits, at the shorter length or ``most``; 100 for two empty, 0 for one."""
    na, nb = F.size(a), F.size(b)
    points = F.least(na, nb, F.lit(most)) if most > 0 else F.least(na, nb)
    apart = F.aggregate(F.zip_with(resample(a, points), resample(b, points), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v)
    return F.when((na == 0) & (nb == 0), 100.0).when((na == 0) | (nb == 0), 0.0).otherwise(clamp_percent(100 * (1 - apart / points / 8)))


def score_of(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    """``pair_id, similarity_percent`` alone."""
    sides = both_sides(pairs, profiles(images, opts, errors=True))
    score = profile_similarity(F.col("a.profile"), F.col("b.profile"), opts.max_profile_points)
    return with_error(sides.select("pair_id", score.alias("similarity_percent"), F.coalesce("a.error", "b.error").alias("error")), F.col("error"))


def section(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    sides = both_sides(pairs, profiles(images, opts, errors=True))
    a, b = (profile_stats(F.col(f"{s}.profile"), opts.high_entropy) for s in "ab")
    s = sides.select(
        "pair_id", F.coalesce("a.error", "b.error").alias("error"), profile_similarity(F.col("a.profile"), F.col("b.profile"), opts.max_profile_points).alias("similarity_percent"), F.lit(opts.block).alias("block_size"),
        *[side[k].alias(f"{k}_{name}") for k in ("mean", "max", "high") for name, side in (("a", a), ("b", b))],
        downsample(F.col("a.profile"), opts.max_profile_points).alias("profile_a"), downsample(F.col("b.profile"), opts.max_profile_points).alias("profile_b"),
    )
    both = lambda x, y, unit: F.concat(number_text(x), F.lit(f"{unit} / "), number_text(y))
    s = s.withColumn(
        "metrics",
        metrics(
            ("Profile similarity", percent_text(F.col("similarity_percent"))), ("Block size", whole_text(F.col("block_size"))),
            ("Mean entropy A / B", F.concat(both(F.col("mean_a"), F.col("mean_b"), ""), F.lit(" bit"))),
            ("Maximum entropy A / B", F.concat(both(F.col("max_a"), F.col("max_b"), ""), F.lit(" bit"))),
            ("High-entropy share A / B", F.concat(both(F.col("high_a") * 100, F.col("high_b") * 100, " %"), F.lit(" %"))),
        ),
    )
    return with_error(s, F.col("error"))

"""Payload tables (`images`) and the pairs to compare (`pairs`).

images: image_id, path, name, data binary, size, sha256 (upper-case hex)
pairs:  pair_id, a_id, b_id
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def with_info(df: DataFrame) -> DataFrame:
    """Add name, size and digest to ``image_id, path, data``."""
    return df.select(
        "image_id", "path", file_name("path").alias("name"), "data",
        F.octet_length("data").cast("long").alias("size"), F.upper(F.sha2("data", 256)).alias("sha256"),
    )


def load_images(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """Files as images, their path as image_id.  A blank or missing path raises."""
    if not paths or any(not p or not p.strip() for p in paths):
        raise ValueError("a path is blank")
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    files = reader.load(list(paths))
    return with_info(files.select(F.col("path").alias("image_id"), "path", F.col("content").alias("data")))


def images_from_bytes(spark: SparkSession, payloads: dict[str, bytes]) -> DataFrame:
    """In-memory payloads by name; null names or payloads raise."""
    if any(k is None or v is None for k, v in payloads.items()):
        raise ValueError("a name or payload is null")
    rows = [(k, k, bytearray(v)) for k, v in payloads.items()]
    return with_info(spark.createDataFrame(rows, "image_id string, path string, data binary"))


def images_from_text(df: DataFrame, id_col: str, text_col: str, prefix: str = "") -> DataFrame:
    """Rows of a text table as images of their UTF-8 bytes; null text is empty."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return with_info(df.select(F.col(id_col).alias("image_id"), F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("path"), data.alias("data")))


def image_info(images: DataFrame) -> DataFrame:
    """Everything but the payload, which is then never read where the source is columnar."""
    return images.select("image_id", "path", "name", "size", "sha256")


def size_warnings(images: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """``pair_id, warnings``: a message for each side larger than ``limit``; none where limit <= 0."""
    sides = both_sides(pairs, images.select("image_id", "size"))

    def message(label: str, size: str) -> Column:
        text = F.format_string(f"File {label} is large (%s bytes); analysis may take time.", F.format_number(size, 0))
        return F.when((F.lit(limit) > 0) & (F.col(size) > limit), text)

    return sides.select("pair_id", F.array_compact(F.array(message("A", "a.size"), message("B", "b.size"))).alias("warnings"))


def both_sides(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """``pair_id, a, b``: the features of both images of each pair, as structs."""
    one = features.select("image_id", F.struct(*features.columns).alias("side"))
    a = one.select(F.col("image_id").alias("a_id"), F.col("side").alias("a"))
    b = one.select(F.col("image_id").alias("b_id"), F.col("side").alias("b"))
    return pairs.select("pair_id", "a_id", "b_id").join(a, "a_id").join(b, "b_id").select("pair_id", "a", "b")


def neighbour_pairs(images: DataFrame) -> DataFrame:
    """Pairs (i, i + 1) of images with integer ids."""
    i = F.col("image_id").cast("long")
    ids = images.select(i.alias("a_id"))
    after = images.select((i - 1).alias("a_id"), i.alias("b_id"))
    return ids.join(after, "a_id").select(F.col("a_id").alias("pair_id"), "a_id", "b_id")


def pairs_from(spark: SparkSession, pairs: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "pair_id string, a_id string, b_id string")

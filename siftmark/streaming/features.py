"""Per-image features over a stream of arriving files: each is computed once, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.images import with_info


def stream_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files of a folder as they arrive, as images."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return with_info(files.select(F.col("path").alias("image_id"), "path", F.col("content").alias("data")))


def write_features(images: DataFrame, features: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append ``features(images)`` as Parquet; the checkpoint makes each file count once."""
    writer = features(images).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""What several operators share: shared-folder tables, hot-key lookups, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least rows / HOT_PARTS rows is hot; at most HOT_PARTS keys can be.
HOT_PARTS = 2048


_KEPT: list = [None, None]


def worker_cache(name: str, make):
    """What a Python worker keeps between tasks: one operator's cache, the latest's alone."""
    if _KEPT[0] != name:
        _KEPT[:] = [name, None]
        _KEPT[1] = make()
    return _KEPT[1]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the worker returns to the system what it no longer uses: idle workers stay small."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return done


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB instead of the default 64 MB, for the session: texts are long, and workers several.

    Plans are lazy, so the setting must outlive the call; one that the caller chose stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864", "67108864b"):
        spark.conf.set(key, "4194304b")


def return_heap(spark: SparkSession) -> None:
    """Executors collect their garbage, upon which their JVMs return unused heap to the system.

    A JVM keeps the heap that an earlier stage made it take, though the next one fills Python workers.
    As many tasks as cores, while nothing else runs, reach every executor; one missed keeps its heap, no more.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or where it is unset a local one, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siftmark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the file system drops it when the session ends."""
    path = f"{shared_folder(spark)}/siftmark-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    files = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(parent)
    files.deleteOnExit(parent)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftmark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_siftmark_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join ``rows`` with ``table`` (one row a key; ``weight`` = rows of that key).

    Keys with ``weight >= total / HOT_PARTS`` are at most HOT_PARTS many, so they
    are broadcast and their rows never shuffle; all others meet by a shuffled join.
    Rows with a null key keep nulls.
    """
    limit = max(2, total // HOT_PARTS)
    hot = table.filter(F.col(weight) >= limit)
    cold = table.filter(F.col(weight) < limit)
    known = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key, "inner").unionByName(
        rows.join(known, key, "left_anti").join(cold, key, "left")
    )


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` over ``vertices(id)``: ``id, comp`` with comp the smallest id.

    Minimum labels travel along edges and by pointer jumping until nothing moves;
    each round is written to the shared folder and its lineage cut.
    """
    # joins run at the shuffle's width; what they give is dealt to files of 50,000 labels or so, as each round writes and reads them
    files = max(1, vertices.count() // 50_000)
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().repartition(4 * files), "edges")
    labels = stored(
        vertices.select("id").join(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")), "id", "left"
        ).select("id", F.least("id", F.coalesce("near", "id")).alias("comp")).repartition(files),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("near").alias("near"))
        )
        hooked = labels.join(near, "id", "left").select(
            "id", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp")
        )
        # a label's own label is never larger: jump to it
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        moved = stored(
            hooked.join(up, "comp", "left").select(
                "id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")
            ).repartition(files),
            "labels",
        )
        changed = moved.filter("comp <> was").limit(1).count()
        discard(labels)
        labels = moved.select("id", "comp")
        labels._siftmark_path = moved._siftmark_path
        if not changed:
            discard(both)
            return labels


__all__ = ["HOT_PARTS", "components", "discard", "fresh_path", "lookup", "return_heap", "shared_folder", "stored", "tidy"]

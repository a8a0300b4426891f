"""PE/ELF structure: header summaries, sections and imports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.executables import SUMMARY_TYPE, parse_executable, unknown
from ..functions.expressions import clamp_percent, histogram_cosine, message, metrics, percent_text, set_jaccard, whole_text, with_error
from ..options import CompareOptions
from ..sources.images import both_sides

_SECTION = pa.struct([
    ("name", pa.string()), ("virtual_size", pa.int64()), ("raw_size", pa.int64()), ("entropy", pa.float64()),
    ("sha256", pa.string()), ("flags", pa.string()), ("bins", pa.list_(pa.int64())),
])
_SUMMARY = [("format", pa.string()), ("machine", pa.string()), ("time_stamp", pa.string()), ("subsystem", pa.string()), ("entry_point", pa.string()), ("sections", pa.list_(_SECTION)), ("imports", pa.list_(pa.string())), ("error", pa.string())]


def _parsed(data: bytes) -> dict:
    try:
        return {**parse_executable(data), "error": None}
    except Exception as problem:  # noqa: BLE001  one payload's failure is its own row
        return {**unknown(), "error": message(problem)}


def summaries(images: DataFrame) -> DataFrame:
    """``image_id`` and the header summary of every payload, sections with their byte counts; ``error`` is null but for one that fails."""
    id_type = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [_parsed(c.as_buffer().to_pybytes() if c.is_valid else b"") for c in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in _SUMMARY]], names=["image_id", *[k for k, _ in _SUMMARY]])

    return images.select("image_id", "data").mapInArrow(run, f"image_id {id_type}, {SUMMARY_TYPE}, error string")


def sections(images: DataFrame) -> DataFrame:
    """A row for each section, numbered in table order."""
    rows = summaries(images).select("image_id", F.posexplode("sections").alias("section_idx", "s"))
    return rows.select("image_id", "section_idx", "s.name", "s.virtual_size", "s.raw_size", "s.entropy", "s.sha256", "s.flags", "s.bins")


def section_rows_compared(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pair_id, ord, name, in_a, in_b, similarity_percent``: a full outer join of sections by name.

    Of sections with one name the first stands for it, and the first with content lends its
    counts.  A's order comes first, then B's other names in order of code points.
    """
    one = found.groupBy("image_id", "name").agg(
        F.min("section_idx").alias("idx"), F.min_by("sha256", "section_idx").alias("sha"),
        F.min_by("bins", F.when(F.col("bins").isNotNull(), F.col("section_idx"))).alias("bins"),
    )
    side = lambda x: pairs.join(one, pairs[f"{x}_id"] == one["image_id"]).select("pair_id", "name", *[F.col(c).alias(f"{c}_{x}") for c in ("idx", "sha", "bins")])
    met = side("a").join(side("b"), ["pair_id", "name"], "full_outer")
    in_a, in_b = F.col("idx_a").isNotNull(), F.col("idx_b").isNotNull()
    same = (F.col("sha_a") != "") & (F.col("sha_a") == F.col("sha_b"))
    score = F.when(same, 100.0).otherwise(clamp_percent(100 * histogram_cosine(F.col("bins_a"), F.col("bins_b"))))
    order = F.struct(in_b & ~in_a, F.coalesce("idx_a", F.lit(0)), F.when(in_a, F.lit("")).otherwise(F.col("name")))
    return met.select("pair_id", order.alias("ord"), "name", in_a.alias("in_a"), in_b.alias("in_b"), F.when(in_a & in_b, score).alias("similarity_percent"))


def import_sets(a: Column, b: Column) -> dict[str, Column]:
    return {"common": F.array_sort(F.array_intersect(a, b)), "only_a": F.array_sort(F.array_except(a, b)), "only_b": F.array_sort(F.array_except(b, a))}


def headline(names_a: Column, names_b: Column, imports_a: Column, imports_b: Column, applicable: Column) -> Column:
    """Section-name Jaccard, averaged with the imports' where either side has any; null where neither is recognised."""
    by_name = 100.0 * set_jaccard(names_a, names_b)
    by_import = 100.0 * set_jaccard(imports_a, imports_b)
    some = (F.size(imports_a) > 0) | (F.size(imports_b) > 0)
    return F.when(applicable, clamp_percent(F.when(some, (by_name + by_import) / 2).otherwise(by_name)))


def score_of(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    """``pair_id, similarity_percent`` alone: names meet, section contents don't."""
    names = F.transform("sections", lambda x: x["name"]).alias("names")
    sides = both_sides(pairs, summaries(images).select("image_id", "format", names, "imports", "error"))
    applicable = F.col("a.format").isin("PE", "ELF") | F.col("b.format").isin("PE", "ELF")
    score = headline(F.col("a.names"), F.col("b.names"), F.col("a.imports"), F.col("b.imports"), applicable)
    return with_error(sides.select("pair_id", score.alias("similarity_percent"), F.coalesce("a.error", "b.error").alias("error")), F.col("error"))


def section(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    found = summaries(images)
    sides = both_sides(pairs, found)
    applicable = F.col("a.format").isin("PE", "ELF") | F.col("b.format").isin("PE", "ELF")
    imports = import_sets(F.col("a.imports"), F.col("b.imports"))
    names = lambda s: F.transform(F.col(f"{s}.sections"), lambda x: x["name"])
    bare = lambda s: F.col(s).withField("sections", F.transform(F.col(f"{s}.sections"), lambda x: x.dropFields("bins"))).dropFields("image_id", "error")
    s = sides.select(
        "pair_id", F.coalesce("a.error", "b.error").alias("error"), headline(names("a"), names("b"), F.col("a.imports"), F.col("b.imports"), applicable).alias("similarity_percent"),
        applicable.alias("applicable"), bare("a").alias("a"), bare("b").alias("b"), *[v.alias(f"imports_{k}") for k, v in imports.items()],
    )
    rows = found.select("image_id", F.posexplode("sections").alias("section_idx", "s")).select("image_id", "section_idx", "s.*")
    compared = section_rows_compared(pairs, rows).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "in_a", "in_b", "similarity_percent"))).alias("rows"))
    kept = F.transform("rows", lambda r: F.struct(r["name"].alias("name"), r["in_a"].alias("in_a"), r["in_b"].alias("in_b"), r["similarity_percent"].alias("similarity_percent")))
    s = s.join(compared.select("pair_id", kept.alias("comparisons")), "pair_id", "left")
    none = F.array().cast("array<struct<name:string,in_a:boolean,in_b:boolean,similarity_percent:double>>")
    slash = lambda x, y: F.concat(x.cast("string"), F.lit(" / "), y.cast("string"))
    first = metrics(("Format A / B", slash(F.col("a.format"), F.col("b.format"))), ("Structural similarity", percent_text(F.col("similarity_percent"))))
    more = metrics(
        ("Sections A / B", slash(F.size("a.sections"), F.size("b.sections"))), ("Shared imports", whole_text(F.size("imports_common"))),
        ("Imports only in A / B", slash(F.size("imports_only_a"), F.size("imports_only_b"))),
    )
    s = s.withColumn("comparisons", F.coalesce("comparisons", none)).withColumn("metrics", F.when(F.col("applicable"), F.concat(first, more)).otherwise(first))
    return with_error(s, F.col("error"))

"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp_percent(x: Column) -> Column:
    """0 to 100; what is not a number is 0; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(x, F.lit(0.0)))))


def _digits_text(k: Column, digits: int) -> Column:
    """The whole number k over 10**digits, with that many decimals."""
    return F.concat((k / 10**digits).cast("long").cast("string"), F.lit("."), F.lpad((k % 10**digits).cast("string"), digits, "0"))


def fixed_text(x: Column, digits: int) -> Column:
    """As C's printf: the double's exact value decides, an exact half goes to the even digit.  (Java's format rounds its shortest decimal.)

    x lies between k and k + 1 of the last digit.  Where it is the double next to the half between them, the half's exact
    place is told by parts of the double whose products are exact below 2**20.
    """
    scale = 10**digits
    k = F.floor(x * scale)
    odd = (2 * k + 1).cast("double")
    half = odd / (2 * scale)
    head = F.floor(half * (1 << 20)).cast("double") / (1 << 20)
    over = (head * (2 * scale) - odd) + (half - head) * (2 * scale)  # half less its exact place: the first difference is exact too
    up = (x > half) | ((x == half) & ((over > 0) | ((over == 0) & (k % 2 == 1))))
    return F.when((x >= 0) & (x < 1 << 20), _digits_text(k + up.cast("long"), digits)).otherwise(F.format_string(f"%.{digits}f", x))


def percent_text(x: Column) -> Column:
    """Rounded half up as a double to two decimals."""
    cents = F.floor(x * 100)
    text = _digits_text(cents + (x * 100 - cents >= 0.5).cast("long"), 2)
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.concat(F.when((x >= 0) & (x < 1 << 20), text).otherwise(F.format_string("%.2f", x)), F.lit(" %")))


def exact_percent_text(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.concat(fixed_text(x, 2), F.lit(" %")))


def whole_text(x: Column) -> Column:
    return F.format_number(x, 0)


def number_text(x: Column) -> Column:
    """At most three decimals, none that are zero."""
    return F.regexp_replace(fixed_text(x, 3), r"\.?0+$", "")


def hex_spaced(data: Column | str) -> Column:
    """Upper-case hex bytes with a blank between them."""
    return F.btrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def metrics(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("Key"), v.alias("Value")) for k, v in pairs])


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, v: t + v)


def histogram_cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of counts, 0 where one is null or empty of counts."""
    down = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(down > 0, F.least(F.lit(1.0), dot(x, y) / down)).otherwise(F.lit(0.0))


def set_jaccard(x: Column, y: Column) -> Column:
    """Shared part of two arrays taken as sets; 1 where both are empty."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def message(problem: Exception) -> str:
    return str(problem) or type(problem).__name__


def with_error(section: DataFrame, error: Column) -> DataFrame:
    """``section`` with its ``error``: where there is one, the score is null and the message the only metric."""
    out = section.withColumn("error", error)
    out = out.withColumn("similarity_percent", F.when(F.col("error").isNull(), F.col("similarity_percent")))
    if "metrics" in section.columns:
        out = out.withColumn("metrics", F.when(F.col("error").isNull(), F.col("metrics")).otherwise(metrics(("Error", F.col("error")))))
    return out


def kernel(images: DataFrame, each: Callable[[bytes], Iterator[tuple] | list[tuple]], fields: dict[str, pa.DataType], spark_types: str, errors: bool = False) -> DataFrame:
    """``image_id`` and the fields of every row that ``each`` gives for a payload.

    Payloads stay within their task; output is cut into batches of a few thousand rows.  With
    ``errors`` a payload on which ``each`` raises is one row of nulls and its ``error``, which is null elsewhere.
    """
    given = each
    if errors:
        fields, spark_types = {**fields, "error": pa.string()}, f"{spark_types}, error string"

        def each(data: bytes) -> list[tuple]:
            try:
                return [(*row, None) for row in given(data)]
            except Exception as problem:  # noqa: BLE001  one payload's failure is its own row
                return [(None,) * (len(fields) - 1) + (message(problem),)]

    names = list(fields)
    id_type = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept, columns = batch.column(0), [], [[] for _ in names]

            def flush():
                values = [ids.take(pa.array(kept, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)]
                return pa.RecordBatch.from_arrays(values, names=["image_id", *names])

            for k, cell in enumerate(batch.column(1)):
                for row in each(cell.as_buffer().to_pybytes() if cell.is_valid else b""):
                    kept.append(k)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                if len(kept) >= 20_000:
                    yield flush()
                    kept, columns = [], [[] for _ in names]
            if kept:
                yield flush()

    return images.select("image_id", "data").mapInArrow(run, f"image_id {id_type}, {spark_types}")

"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm.common import return_heap, small_batches, stored
from siftmark.llm.jaccard import drop_near_duplicates
from siftmark.llm.linededup import drop_boilerplate
from siftmark.llm.mixing import mixed_documents
from siftmark.llm.packing import pack_documents
from siftmark.llm.queries import table, tokenizer_path
from siftmark.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def begin(spark: SparkSession) -> None:
    """What every stage does first: executors still hold the heap of the stage before, and batches of 64 MB may be set."""
    small_batches(spark)
    return_heap(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.7 or more go; it learns from ``labels`` of ``sf_dir``.

    Null, empty and blank texts score the machine's intercept and stay where that is below 0.7; rows
    with null or repeated ids are scored each by its own text; other columns, whatever their names,
    are handed on.  An empty table stays empty, and without labels nothing goes.
    """
    begin(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than 2 % of a source's different texts, and on 3 of them, go; no document does.

    Null texts stay null and hold no lines; a null source is one source; ids may be null or repeat,
    as rows are kept as they are; copies count as one text; a text whose lines all go is empty; of
    the other columns only n_chars changes, to the characters left.  An empty table stays empty.
    """
    begin(spark)
    cleaned = drop_boilerplate(docs, "doc_id", "source", "text", ratio=0.02, min_pages=3, copies_once=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on 5-word shingles one stays, of the smallest id.

    Null ids are linked like others and stay where a group has no other; an id on several texts keeps
    each text that is no duplicate; texts without words link with nothing: one of each id stays, and
    all with a null id.  Other columns, whatever their names, are handed on.  An empty table stays empty.
    """
    begin(spark)
    return drop_near_duplicates(docs, words=5, num=4, den=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice.

    Null texts and texts without words are never taken; a null source is a source; rows with null or
    repeated ids are drawn each by id and text.  Other columns are handed on.  An empty table stays empty.
    """
    begin(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 4096: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is its end id alone; a null id is kept; rows that repeat are packed as often as they
    occur; long texts are cut into pieces of 4096.  Other columns are not read.  An empty table gives no rows.
    """
    begin(spark)
    return pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1, cache_words=250_000)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: A factorization machine, a similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

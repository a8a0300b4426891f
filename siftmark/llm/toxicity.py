"""Operator 10: toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the first letters of its longer words, hashed.
The machine adds a weight for each term and the product of two terms' factors for each
pair, so that an insult next to a group mention can weigh more than both apart.  It is
fitted on the driver on a bounded sample of labelled rows; scoring reads every text whole.

Defined results: null and empty texts have no terms and score the machine's intercept;
rows that repeat score alike; without labelled rows every score is 0, and with one class
only it is the smoothed base rate; labels that repeat count once, the largest, and so do
documents that repeat an id; null labels and ids teach nothing; a null doc_id is scored and not held out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, worker_cache

#: Labelled rows the machine is fitted on at most, taken in the order of a hash of doc_id.
MAX_TRAINING_ROWS = 8_000
#: Term ids of those rows at most (4 bytes each, some 30 while the machine is fitted): later rows are left out.
MAX_TRAINING_IDS = 8_000_000
BUCKETS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
CACHE_WORDS = 150_000


class TermIds(dict):
    """Word -> hashed ids of its terms as bytes; emptied when full, so memory is bounded."""

    def __missing__(self, word: str) -> bytes:
        terms = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
        found = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms], np.int32).tobytes()
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Distinct term ids of a text, ascending."""
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(WORD.findall(text.lower())))), np.int32))


@dataclass
class Machine:
    """score = sigmoid(bias + sum w + pairwise products of factors) over the known terms of a text."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        at = np.searchsorted(self.terms, ids)
        inside = at < len(self.terms)
        at, ids = at[inside], ids[inside]
        at = at[self.terms[at] == ids]
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def evidence(yes1: np.ndarray, yes0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio G2 that rows with a term, ``yes1`` of label 1 and ``yes0`` of 0, differ from the others of n1 and n0; 0 where they point away from label 1."""

    def bits(part, whole):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(part > 0, part * np.log(part / whole), 0.0)

    yes, no = yes1 + yes0, n1 + n0 - yes1 - yes0
    g2 = 2 * (bits(yes1, yes) + bits(yes0, yes) + bits(n1 - yes1, no) + bits(n0 - yes0, no) - bits(np.array(n1), n1 + n0) - bits(np.array(n0), n1 + n0))
    return np.where(yes1 * (n1 + n0) > yes * n1, g2, 0.0)


def partners(ids: np.ndarray, ends: np.ndarray, labels: np.ndarray, seeds: np.ndarray, least_g2: float, most_ids: int) -> np.ndarray:
    """Seeds, and terms that point to label 1 among the rows that hold them, whatever they do elsewhere.

    Seeds come strongest first, and end where their rows hold ``most_ids`` ids together.
    """
    if not len(seeds):
        return np.empty(0, ids.dtype)
    doc = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(ends))
    order = np.argsort(ids, kind="stable")
    sorted_ids, seen, found = ids[order], 0, []
    for seed in seeds.tolist():
        mine = doc[order[np.searchsorted(sorted_ids, seed) : np.searchsorted(sorted_ids, seed, "right")]]
        lengths = ends[mine + 1] - ends[mine]
        seen += int(lengths.sum())
        if seen > most_ids:
            break
        at = np.repeat(ends[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        one = np.repeat(labels[mine] == 1, lengths)
        n1 = int((labels[mine] == 1).sum())
        if not 0 < n1 < len(mine):
            continue
        near, place = np.unique(ids[at], return_inverse=True)
        yes1 = np.bincount(place[one], minlength=len(near))
        g2 = evidence(yes1, np.bincount(place, minlength=len(near)) - yes1, n1, len(mine) - n1)
        near = near[(g2 >= least_g2) & (near != seed)]
        if len(near):
            found += [near, np.array([seed], ids.dtype)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, ids.dtype)


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, steps: int = 400, least_g2: float = 16.0, sure_share: float = 0.85, seed_g2: float = 6.0, pair_g2: float = 30.0, pair_ids: int = 40_000_000) -> Machine:
    """Fit a machine by full-batch Adam on the terms that point to label 1 beyond chance.

    They do so by themselves (G2 of ``least_g2``), or together: of the rows that hold no sure term (a
    share ``sure_share`` of label 1) those with a term that points there mildly (``seed_g2``) are split by each
    other term; among as many pairs as there are, ``pair_g2`` is beyond chance, and both terms
    count.  Other terms only add noise that grows with a text's length.
    """
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    none = np.empty(0, np.int32)
    base = (n1 + 0.5) / (n1 + n0 + 1) if n1 + n0 else 0.0
    bias = float(np.log(base / (1 - base))) if base else -40.0
    if not n1 or not n0:
        return Machine(none, bias, np.empty(0), np.empty((0, rank)))
    lengths = np.array([len(r) for r in rows])
    n = len(rows)
    ids, doc = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), lengths)
    rows = None  # the driver's memory holds one copy
    toxic = labels == 1  # a byte a row, where millions of ids are looked up
    c1 = np.bincount(ids[toxic[doc]], minlength=BUCKETS)
    c0 = np.bincount(ids, minlength=BUCKETS) - c1
    strong = np.flatnonzero(evidence(c1, c0, n1, n0) >= least_g2).astype(np.int32)
    # rows that a sure term explains say nothing of pairs
    sure = strong[(c1[strong] + 0.5) / (c1[strong] + c0[strong] + 1) >= sure_share]
    open_rows = np.ones(n, bool)
    open_rows[doc[np.isin(ids, sure)]] = False
    inside = open_rows[doc]
    left, rest = ids[inside], labels[open_rows]
    one = np.bincount(left[toxic[doc[inside]]], minlength=BUCKETS)
    own = evidence(one, np.bincount(left, minlength=BUCKETS) - one, int(rest.sum()), int(len(rest) - rest.sum()))
    del inside, one
    seeds = np.flatnonzero(own >= seed_g2)
    seeds = seeds[np.argsort(-own[seeds], kind="stable")].astype(np.int32)
    pairs = partners(left, np.concatenate(([0], np.cumsum(lengths[open_rows]))), rest, seeds, pair_g2, pair_ids)
    terms = np.union1d(strong, pairs)
    del left
    known = np.isin(ids, terms)
    at, doc = np.searchsorted(terms, ids[known]), doc[known]
    m = len(terms)
    draw = np.random.default_rng(0)
    p = [np.array([bias]), np.zeros(m), draw.normal(0, 0.01, (m, rank))]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    decay = (0.0, 1e-6, 3e-3)
    # the rarer class counts more, by the root of the ratio
    weight = np.where(labels == 1, np.sqrt(n0 / n1), 1.0)
    weight /= weight.sum()

    def gather(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, values[:, f], size) for f in range(rank)], 1)

    for step in range(1, steps + 1):
        v = p[2][at]
        s = gather(v, doc, n)
        zed = p[0][0] + np.bincount(doc, p[1][at], n) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (v**2).sum(1), n))
        g = (1 / (1 + np.exp(-np.clip(zed, -40, 40))) - labels) * weight
        ge = g[doc]
        grads = [np.array([g.sum()]), np.bincount(at, ge, m), gather(ge[:, None] * (s[doc] - v), at, m)]
        for k in range(3):
            grad = grads[k] + decay[k] * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            p[k] = p[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def held_out(doc_id: Column | str) -> Column:
    """Rows whose crc32 of the id as text leaves 1 by 3: never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, learn_from: Column | None = None, seed: int = 0, max_ids: int = MAX_TRAINING_IDS) -> Machine:
    """Fit on at most ``max_rows`` labelled documents, chosen by a hash of their id, and ``max_ids`` term ids of them.

    Of documents with one id the terms that sort first count.
    """
    usable = labels.filter("doc_id is not null and toxic is not null")
    if learn_from is not None:
        usable = usable.filter(learn_from)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    # max_rows rows at most: small enough for every task
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("terms", TermIds)
        for batch in batches:
            ids = [known.of(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "ids"])

    rows = texts.mapInArrow(tidy(terms), "doc_id long, toxic int, ids binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("ids").alias("ids"))
    # max_rows rows meet in one task; the driver takes those whose terms fit its memory
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = rows.withColumn("upto", F.sum(F.octet_length("ids")).over(order)).filter(F.col("upto") <= 4 * max_ids).select("toxic", "ids").collect()
    ids, labels_of = [np.frombuffer(r["ids"], np.int32) for r in fitting], np.array([int(r["toxic"] > 0) for r in fitting])
    del fitting
    return fit(ids, labels_of)


def score_documents(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("terms", TermIds)
        for batch in batches:
            scores = [machine.score(known.of(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(tidy(score), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    machine = train(docs, labels, learn_from=~held_out("doc_id"))
    return score_documents(docs, machine, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns."""
    machine = train(docs, labels, learn_from=~held_out("doc_id"))
    columns = docs.columns
    text_at = columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("terms", TermIds)
        for batch in batches:
            clean = [machine.score(known.of(t.as_py() or "")) < threshold for t in batch.column(text_at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)

"""Operator 7: mixing sources to target weights by Pareto order sampling.  DataFrame functions only.

Each source gets a target in words: weights share a multiple of all words, no source
passes ``most`` times its own, and what is cut off is shared out again.  Within a
source a document of s words is expected in min(most, c * s**-damping) copies, in
steps of powers of two of s, so long documents weigh less; c meets the target.  Whole
expected copies are certain.  For the rest documents are ranked by the odds of a random
number over the odds of their remaining inclusion probability, and the first ones whose
words fill the target are taken: a sample of fixed size, in words.

The cut in the ranking is found by histograms of the rank, twice, and exactly within
one bin in a million, so no source meets in one task.  The mix is then a small table, a
row for each source and class of sizes, and every document's copies follow from it alone.

Defined results: null text has size 0; documents without words are never taken; null
source is a source, the last; the random number comes from id and text, so rows tie only
where both repeat (of those as many are taken as fit, it doesn't matter which); null ids
are ids like others; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
BINS = 1024


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, nulls last: ranges, then ranks within each."""
    order = F.col("source").asc_nulls_last()
    dealt = stored(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").count().orderBy("part").collect()  # one number a partition
    ends, total = [], 0
    for c in counts:
        ends.append((c["part"], total))
        total += c["count"]
    starts = F.broadcast(sizes.sparkSession.createDataFrame(ends, "part int, start long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("rank", rank).join(starts, "part").select("source", "source_size", (F.col("rank") + F.col("start")).alias("rank"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    The level rises round by round: sources at their ceiling leave, their excess goes to
    the rest by weight, until none is above.  A round is one aggregation.
    """
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(_ranked_sources(sizes).withColumn("weight", choose), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    ceiling = most * F.col("source_size")
    while True:
        above = ceiling <= level * F.col("weight")
        full, free = ranked.agg(
            F.coalesce(F.sum(F.when(above, ceiling)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        after = (share * total - full) / free if free else level
        if after <= level:
            break
        level = after
    return ranked.select("source", "source_size", F.least(ceiling, F.col("weight") * F.lit(max(level, 0.0))).alias("target"))


def _expected_copies(classes: DataFrame, damping: float, most: float) -> DataFrame:
    """Add ``copies`` to (source, class): min(most, c * 2**(-damping * class)) with c meeting the target.

    Short classes reach ``most`` first; c is the one for which exactly those above it are full.
    """
    h = F.pow(F.lit(2.0), -damping * F.col("class"))
    by = Window.partitionBy("source").orderBy("class")
    full = F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * h).over(by.rowsBetween(0, Window.unboundedFollowing))
    c = F.try_divide(F.col("target") - most * full, open_)  # null where no class has words
    valid = F.when(c * h <= most, F.struct("class", c.alias("c")))
    level = F.min("valid").over(Window.partitionBy("source"))["c"]
    copies = F.round(F.greatest(F.lit(0.0), F.coalesce(F.least(F.lit(most), level * h), F.lit(most))), 9)
    return classes.withColumn("valid", valid).withColumn("copies", copies).drop("valid")


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _cut(counts: DataFrame, goal: str) -> DataFrame:
    """``source, edge, rest``: the bin in which the words reach the goal, and what is still wanted there."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    found = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col(goal)) & (F.col("upto") - F.col("words") < F.col(goal)))
    return found.select("source", F.col("bin").alias("edge"), (F.col(goal) - F.col("upto") + F.col("words")).alias("rest"))


def _drawn(docs: DataFrame, seed: str) -> list[Column]:
    """``source, size, class, draw`` of a row; the draw is a number below 2**52 that id and text fix."""
    size = word_count("text")
    # md5's first 52 bits: equal wherever they are computed, and apart for rows that share an id alone
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col("text"), F.lit("")))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return [F.col("source"), size.alias("size"), (F.length(F.bin(size)) - 1).cast("int").alias("class"), draw.alias("draw")]


def _place(draw: Column | str, chance: Column | str) -> Column:
    """Rank in (0, 1): the odds of the draw over the odds of the chance, as a share; null without a chance."""
    u = (F.col(draw).cast("double") + 0.5) / 4503599627370496.0
    odds = (u / (1 - u)) / (F.col(chance) / (1 - F.col(chance)))
    return F.when((F.col(chance) > 0) & (F.col("size") > 0), odds / (1 + odds))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan, _same_source(rows, plan) & (rows["class"] == plan["class"])).drop(plan["source"], plan["class"])


def _plan(rows: DataFrame, weights, share: float, most: float, damping: float) -> DataFrame:
    """The mix of stored ``rows(source, size, class, draw)``, a row for each source and class of sizes.

    ``source, class, source_size, target, certain, chance`` and the source's cut: rows of a place under
    ``cut`` give one more copy; of ``n_at`` rows at it, which are equal, ``take`` do.
    """
    classes = stored(rows.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    targets = stored(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    c = classes.join(targets, _same_source(classes, targets)).select(classes["source"], "class", "words", "source_size", "target")
    c = _expected_copies(c, damping, most)
    certain = F.floor("copies")
    c = c.select("source", "class", "words", "source_size", "target", certain.alias("certain"), (F.col("copies") - certain).alias("chance"))
    goal = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    c = stored(c.withColumn("goal", goal), "copies").drop("words")
    fine = F.floor(F.col("place") * (BINS * BINS))
    ranked = _joined(rows, c.select("source", "class", "chance", "goal")).withColumn("place", _place("draw", "chance")).filter("place is not null")
    ranked = ranked.select("source", "size", "goal", "place", F.floor(fine / BINS).alias("bin1"), (fine % BINS).alias("bin2"))
    first = _cut(ranked.groupBy("source", F.col("bin1").alias("bin")).agg(F.sum("size").alias("words"), F.first("goal").alias("goal")), "goal")
    first = stored(first.select("source", F.col("edge").alias("edge1"), F.col("rest").alias("rest1")), "edges1")
    near = ranked.join(first, _same_source(ranked, first) & (ranked["bin1"] == first["edge1"])).select(ranked["source"], "place", "bin2", "size", "rest1")
    second = _cut(near.groupBy("source", F.col("bin2").alias("bin")).agg(F.sum("size").alias("words"), F.first("rest1").alias("rest1")), "rest1")
    second = stored(second.select("source", F.col("edge").alias("edge2"), F.col("rest").alias("rest2")), "edges2")
    # a millionth of the source, and rows of one place, which repeat id and text, are one here
    edge = near.join(second, _same_source(near, second) & (near["bin2"] == second["edge2"])).groupBy(near["source"], "place", "size")
    edge = edge.agg(F.count("*").alias("n_at"), F.first("rest2").alias("rest2"))
    by = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("n_at")).over(by), F.lit(0))
    edge = edge.withColumn("take", F.greatest(F.lit(0), F.least("n_at", F.floor((F.col("rest2") - before + F.col("size") / 2) / F.col("size")))).cast("long"))
    at = F.struct(F.col("place").alias("cut"), "n_at", "take")
    cuts = edge.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("take") < F.col("n_at"), at)), F.max(at)).alias("at")).select("source", "at.*")
    out = c.join(cuts, _same_source(c, cuts), "left").drop(cuts["source"])
    # without an edge the goal lies beyond all ranked words, or is nothing
    cut = F.coalesce("cut", F.when(F.col("goal") > 0, 2.0).otherwise(-1.0))
    return stored(out.withColumns({"cut": cut, "n_at": F.coalesce("n_at", F.lit(0)), "take": F.coalesce("take", F.lit(0))}).drop("goal"), "plan")


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``row, source, size, source_size, target, copies`` of ``rows(row, source, size, class, draw)``: nothing but the plan moves."""
    met = _joined(rows, plan).withColumn("place", _place("draw", "chance"))
    at_cut = F.coalesce(F.col("place") == F.col("cut"), F.lit(False))
    extra = F.coalesce(F.col("place") < F.col("cut"), F.lit(False)) | (at_cut & (F.col("take") == F.col("n_at")))
    copies = F.when(F.col("size") > 0, F.col("certain") + extra.cast("long")).otherwise(0).cast("long")
    columns = ["row", "source", "size", "source_size", "target"]
    if not plan.filter("take > 0 and take < n_at").limit(1).count():
        return met.select(*columns, copies.alias("copies"))
    # some rows that repeat id and text give a copy more than others: they are counted, and told apart by the other columns
    some = at_cut & (F.col("take") > 0) & (F.col("take") < F.col("n_at"))
    equal = met.filter(some).groupBy(*columns, "certain", "take").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.greatest(F.lit(0), F.least("n", F.col("take") - F.coalesce(F.sum("n").over(by), F.lit(0))))
    equal = equal.withColumn("mine", mine).select(*columns, F.explode(F.array(
        F.struct((F.col("certain") + 1).alias("copies"), F.col("mine").alias("n")), F.struct(F.col("certain").alias("copies"), (F.col("n") - F.col("mine")).alias("n")),
    )).alias("part")).select(*columns, "part.copies", "part.n")
    # thousands at once, then each
    equal = equal.filter("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(4096))))
    equal = equal.withColumn("at", F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.col("n") - F.col("at")))))
    return met.filter(~some).select(*columns, copies.alias("copies")).unionByName(equal.select(*columns, F.col("copies").cast("long").alias("copies")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, damping: float = 0.25, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies`` of every document."""
    rows = stored(docs.select("doc_id", *_drawn(docs, seed)), "sizes")
    found = _copied(rows.withColumn("row", F.struct("doc_id")), _plan(rows, weights, share, most, damping))
    return found.select("row.doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, damping: float = 0.25, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as many times as :func:`mix` takes it: not at all, or up to ``most`` times.

    Texts stay where they are read: a row's copies follow from the plan of its source and size, and its own draw.
    """
    plan = _plan(stored(docs.select(*_drawn(docs, seed)), "sizes"), weights, share, most, damping)
    # names of docs can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_drawn(docs, seed))
    kept = _copied(rows, plan).filter("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")

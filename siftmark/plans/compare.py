"""Comparisons of whole payloads: every enabled module, and the weighted overall score.

``compare`` returns lazy frames, one a module; ``overall`` and ``results`` join them.
Modules are looked up in a registry, which callers may extend or replace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp_percent
from ..operators import bytediff, entropy, fileformat, fuzzy, patterns
from ..options import MODULES, CompareOptions
from ..sources.images import both_sides, image_info, size_warnings

Analyzer = Callable[[DataFrame, DataFrame, CompareOptions], DataFrame]
ANALYZERS: dict[str, Analyzer] = {
    "ByteDiff": bytediff.section,
    "FuzzyHash": fuzzy.section,
    "Format": fileformat.section,
    "Entropy": entropy.section,
    "Patterns": patterns.section,
}
#: The same modules where only scores are wanted.
SCORERS: dict[str, Analyzer] = {
    "ByteDiff": bytediff.score_of,
    "FuzzyHash": fuzzy.score_of,
    "Format": fileformat.score_of,
    "Entropy": entropy.score_of,
    "Patterns": patterns.score_of,
}
# Titles and kinds of the modules' sections.
TITLES = {"ByteDiff": "Byte-Diff", "FuzzyHash": "Fuzzy-Hash", "Format": "Format (PE/ELF)", "Entropy": "Entropy", "Patterns": "Patterns / signatures"}
KINDS = {"ByteDiff": "byteDiff", "FuzzyHash": "fuzzyHash", "Format": "format", "Entropy": "entropy", "Patterns": "patterns"}


def compare(images: DataFrame, pairs: DataFrame, opts: CompareOptions | None = None, analyzers: dict[str, Analyzer] | None = None) -> dict[str, DataFrame]:
    """A section frame for each enabled module, in running order.

    A module whose plan can't be built gives an error section instead: a null score and a message.  A
    payload on which a module fails gives such a row to its own pairs alone.
    """
    opts, found = opts or CompareOptions(), {}
    registry = ANALYZERS if analyzers is None else analyzers
    for module in [m for m in (*MODULES, *registry) if m in registry and m in opts.modules]:
        if module in found:
            continue
        try:
            frame = registry[module](images, pairs, opts)
            if frame is None:
                raise ValueError("Analyzer returned null.")
        except Exception as problem:  # noqa: BLE001  one module's failure is a row, not the run's end
            text = F.lit(str(problem))
            frame = pairs.select("pair_id", F.lit(None).cast("double").alias("similarity_percent"), text.alias("error"), F.array(F.struct(F.lit("Error").alias("Key"), text.alias("Value"))).alias("metrics"))
        found[module] = frame if "error" in frame.columns else frame.withColumn("error", F.lit(None).cast("string"))
    return found


def module_number(module: str) -> int:
    return MODULES.index(module) if module in MODULES else len(MODULES)


def scores(sections: dict[str, DataFrame]) -> DataFrame:
    """``pair_id, module, module_ord, kind, title, similarity_percent, error, metrics`` of all sections."""
    parts = []
    for module, frame in sections.items():
        failed = F.col("error").isNotNull()
        parts.append(frame.select(
            "pair_id", F.lit(module).alias("module"), F.lit(module_number(module)).alias("module_ord"),
            F.when(failed, "error").otherwise(KINDS.get(module, module)).alias("kind"),
            F.when(failed, f"{module} (Error)").otherwise(TITLES.get(module, module)).alias("title"),
            "similarity_percent", "error", "metrics",
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_mean(rows: DataFrame, opts: CompareOptions) -> DataFrame:
    """``pair_id, overall_percent`` of ``pair_id, module, similarity_percent, error``.

    Null and failed scores and weights that are not positive and finite leave both sums; without any the mean is 0.
    """
    modules = set(MODULES) | set(opts.weights)
    known = {m: opts.weight(m) for m in modules}
    pairs_of = [F.lit(x) for m, w in known.items() if w is not None for x in (m, float(w))]
    weight = F.create_map(*pairs_of)[F.col("module")] if pairs_of else F.lit(None).cast("double")
    unlisted = ~F.col("module").isin(*modules)
    w = F.when(F.col("similarity_percent").isNotNull() & F.col("error").isNull(), F.when(unlisted, 1.0).otherwise(weight))
    # weights are scaled by the largest, so that large ones don't overflow
    top = max([1.0, *[x for x in known.values() if x]])
    mean = F.sum(w / top * F.col("similarity_percent")) / F.sum(w / top)
    usable = F.when(F.isnan(mean) | (F.abs(mean) == float("inf")), 0.0).otherwise(clamp_percent(mean))
    return rows.groupBy("pair_id").agg(F.coalesce(usable, F.lit(0.0)).alias("overall_percent"))


def overall(images: DataFrame, pairs: DataFrame, opts: CompareOptions | None = None) -> DataFrame:
    """``pair_id, overall_percent``: only what the scores need is computed."""
    opts = opts or CompareOptions()
    sections = compare(images, pairs, opts, SCORERS)
    if not sections:
        return pairs.select("pair_id", F.lit(0.0).alias("overall_percent"))
    none = F.lit(None).cast("array<struct<Key:string,Value:string>>")
    return weighted_mean(scores({m: f if "metrics" in f.columns else f.withColumn("metrics", none) for m, f in sections.items()}), opts)


def results(images: DataFrame, pairs: DataFrame, opts: CompareOptions | None = None) -> DataFrame:
    """One row a pair: both files, the overall score, every section as a struct, warnings."""
    opts = opts or CompareOptions()
    sections = compare(images, pairs, opts)
    files = both_sides(pairs, image_info(images)).select("pair_id", F.col("a").alias("file_a"), F.col("b").alias("file_b"))
    out = files.join(size_warnings(images, pairs, opts.large_file_bytes), "pair_id")
    if sections:
        out = out.join(weighted_mean(scores(sections), opts), "pair_id")
    else:
        out = out.withColumn("overall_percent", F.lit(0.0))
    for module, frame in sections.items():
        body = F.struct(*[c for c in frame.columns if c != "pair_id"]).alias(module)
        out = out.join(frame.select("pair_id", body), "pair_id", "left")
    return out.withColumn("generated_at", F.current_timestamp())

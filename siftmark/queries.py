"""Registered queries of the comparison engine, and the DuckDB SQL that checks each.

Images are `documents`, pairs are neighbours (i, i + 1); results carry numbers and text only, and
doubles rounded to six decimals, as sums run in another order elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import clamp_percent, hex_spaced, kernel, metrics, with_error
from .operators import bytediff, entropy, fileformat, fuzzy, patterns
from .options import CompareOptions, next_pow2
from .plans.compare import compare, overall, results, scores, weighted_mean
from .plans.report import span_shares, svg_rows, to_json
from .sources.images import both_sides, image_info, images_from_text, neighbour_pairs, size_warnings, with_info
from .sources.samples import elf_sample, pe_sample

#: Chunks small enough that documents have several: the mask has six bits.
SMALL = CompareOptions(chunk_min=64, chunk_avg=64, chunk_max=256)
DEFAULT = CompareOptions()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images_from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "doc/")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images_from_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "page/")


def _pairs(images: DataFrame) -> DataFrame:
    return neighbour_pairs(images)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def s2_image_bytes(spark, d):
    return pages(spark, d).select(F.col("image_id").alias("page_id"), "size", F.md5("data").alias("md5"))


def s3_image_info(spark, d):
    return image_info(documents(spark, d)).select("image_id", "path", "name", "size", "sha256")


def s4_size_warning(spark, d):
    i = documents(spark, d)
    return size_warnings(i, _pairs(i), 4000).select("pair_id", F.concat_ws("|", "warnings").alias("warnings"))


def b1_gear_table(spark, d):
    from .functions.kernels import gear_table

    return spark.createDataFrame([(i, f"{int(g):016x}") for i, g in enumerate(gear_table())], "i int, gear string")


def b2_chunks(spark, d):
    return bytediff.chunks(documents(spark, d), SMALL)


def b5_chunk_jaccard(spark, d):
    i = documents(spark, d)
    p = _pairs(i)
    return bytediff.chunk_jaccard(p, bytediff.chunks(i, SMALL)).withColumn("jaccard_percent", r6("jaccard_percent"))


def b6_diff_map(spark, d):
    i = documents(spark, d)
    return bytediff.diff_spans(_pairs(i), bytediff.chunks(i, SMALL))


def b7_byte_hist(spark, d):
    return bytediff.byte_counts(documents(spark, d))


def b8_hist_cosine(spark, d):
    i = documents(spark, d)
    return bytediff.histogram_cosines(i, _pairs(i)).withColumn("cosine_percent", r6("cosine_percent"))


def z3_sketch(spark, d):
    return fuzzy.sketch_rows(documents(spark, d), DEFAULT)


def z4_minhash(spark, d):
    i = documents(spark, d)
    return both_sides(_pairs(i), fuzzy.minhash_sketches(i, DEFAULT)).select("pair_id", r6(fuzzy.minhash_percent(DEFAULT.sketch)).alias("minhash_percent"))


def z5_block_size(spark, d):
    return image_info(documents(spark, d)).select("image_id", fuzzy.block_size(F.col("size")).alias("block_size"))


def z8_ctph_digest(spark, d):
    return fuzzy.digests(documents(spark, d)).select("image_id", "digest")


def z9_ctph_score(spark, d):
    i = documents(spark, d)
    return both_sides(_pairs(i), fuzzy.digests(i)).select("pair_id", r6(fuzzy.ctph_percent()).alias("ctph_percent"))


def e1_entropy(spark, d):
    return entropy.shannon_entropy(documents(spark, d)).select("image_id", r6("entropy").alias("entropy"))


def e2_block_entropy(spark, d):
    return entropy.block_rows(documents(spark, d), DEFAULT).select("image_id", "block", r6("entropy").alias("entropy"))


def e3_downsample(spark, d):
    down = entropy.profiles(documents(spark, d), DEFAULT).select("image_id", F.posexplode(entropy.downsample(F.col("profile"), 11)).alias("point", "value"))
    return down.select("image_id", "point", r6("value").alias("value"))


def e5_profile_stats(spark, d):
    stats = entropy.profile_stats(F.col("profile"), 4.0)
    return entropy.profiles(documents(spark, d), DEFAULT).select("image_id", *[r6(v).alias(k) for k, v in stats.items()])


def e6_profile_similarity(spark, d):
    i = documents(spark, d)
    sides = both_sides(_pairs(i), entropy.profiles(i, DEFAULT))
    return sides.select("pair_id", r6(entropy.profile_similarity(F.col("a.profile"), F.col("b.profile"), 512)).alias("similarity"))


def p1_grams(spark, d):
    return patterns.grams(documents(spark, d), DEFAULT).select("image_id", F.hex("gram").alias("hex"), "cnt", "first_offset")


def p4_gram_jaccard(spark, d):
    i = documents(spark, d)
    return patterns.compared(i, _pairs(i), DEFAULT).select("pair_id", "common", "n_union", r6("similarity_percent").alias("jaccard_percent"))


def p4_gram_join(spark, d):
    """The same by joins of pattern tables, packed."""
    i = documents(spark, d)
    return patterns.overlap(i, _pairs(i), DEFAULT).select("pair_id", "common", "n_union", r6("jaccard_percent").alias("jaccard_percent"))


def _hits(spark, d):
    i = documents(spark, d)
    return patterns.hit_rows(patterns.compared(i, _pairs(i), DEFAULT))


def p5_hits_by_join(spark, d):
    i = documents(spark, d)
    return patterns.top_hits(patterns.best_met(i, _pairs(i), DEFAULT), DEFAULT).select("pair_id", "list", "rank", "hex", "count_a", "count_b")


def p5_common_top(spark, d):
    return _hits(spark, d).filter("list = 'common'").select("pair_id", "rank", "hex", "count_a", "count_b", "first_offset_a", "first_offset_b")


def p6_unique_top(spark, d):
    return _hits(spark, d).filter("list <> 'common'").select("pair_id", "list", "rank", "hex", "count_a", "count_b", "first_offset_a", "first_offset_b")


def p7_pattern_score(spark, d):
    i = documents(spark, d)
    return patterns.section(i, _pairs(i), CompareOptions(pattern_length=64)).select("pair_id", r6("similarity_percent").alias("similarity"))


def p11_hex_spaced(spark, d):
    return documents(spark, d).select("image_id", hex_spaced("data").alias("hex"))


# PE and ELF payloads: fixed header bytes in front of each document's own
PE_HEAD = "4D5A" + "00" * 58 + "80000000" + "00" * 64 + "50450000" + "64860100" + "00105E5F" + "00" * 8 + "70002200" + "0B01" + "00" * 14 + "00100000" + "00" * 48 + "0300" + "00" * 42
PE_SECTION = "2E74657874000000" + "00020000" + "00100000" + "00020000" + "A0010000" + "00" * 12 + "20000060"
ELF_HEAD = "7F454C46020101" + "00" * 9 + "02003E00" + "01000000" + "0010400000000000" + "00" * 32


def executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a PE head (even ids), an ELF head (odd ids), or bare (multiples of five)."""
    i = documents(spark, sf_dir)
    head = F.when(F.col("image_id") % 5 == 0, F.lit(b"")).when(F.col("image_id") % 2 == 0, F.unhex(F.lit(PE_HEAD + PE_SECTION))).otherwise(F.unhex(F.lit(ELF_HEAD)))
    return i.select("image_id", "path", "name", F.concat(head, "data").alias("data"))


def f1_magic(spark, d):
    return fileformat.summaries(executables(spark, d)).select("image_id", "format")


def f2_headers(spark, d):
    return fileformat.summaries(executables(spark, d)).select("image_id", "machine", "time_stamp", "subsystem", "entry_point", F.size("sections").alias("n_sections"))


def f3_sections(spark, d):
    return fileformat.sections(executables(spark, d)).select("image_id", "section_idx", "name", "virtual_size", "raw_size", r6("entropy").alias("entropy"), "sha256", "flags")


def f9_section_compare(spark, d):
    i = executables(spark, d)
    rows = fileformat.section_rows_compared(_pairs_by(i, 4), fileformat.sections(i))
    return rows.select("pair_id", "name", "in_a", "in_b", r6("similarity_percent").alias("similarity"))


def _pairs_by(images: DataFrame, step: int) -> DataFrame:
    """Pairs (i, i + step)."""
    i = F.col("image_id")
    return images.select(i.alias("a_id")).join(images.select((i - step).alias("a_id"), i.alias("b_id")), "a_id").select(F.col("a_id").alias("pair_id"), "a_id", "b_id")


#: Import names of the PE payloads, by image_id modulo 4, and sections of the ELF ones, by image_id modulo 2.
IMPORTS = (("KERNEL32.dll", "User32.dll"), ("ws2_32.DLL", "kernel32.dll", "Advapi32.dll", "KERNEL32.DLL"), (), ("Crypt32.dll",))
ELF_SECTIONS = (((".text", 1, b"\x90" * 48), (".bss", 8, bytes(100))), ((".rodata", 1, b"const"), (".symtab", 2, bytes(24)), (".odd", 0x6FFFFFF6, b"x")))


def _with_heads(images: DataFrame, heads: list[bytes]) -> DataFrame:
    """Each payload behind one of ``heads``, by image_id."""
    head = F.element_at(F.array(*[F.unhex(F.lit(h.hex())) for h in heads]), (F.col("image_id") % len(heads) + 1).cast("int"))
    return images.select("image_id", "path", "name", F.concat(head, "data").alias("data"))


def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind PE payloads whose import tables lie in a section: names are found by virtual addresses."""
    return _with_heads(documents(spark, sf_dir), [pe_sample(names) for names in IMPORTS])


def f5_imports(spark, d):
    return fileformat.summaries(importers(spark, d)).select("image_id", "format", "entry_point", F.concat_ws(",", "imports").alias("imports"))


def f7_elf_sections(spark, d):
    i = _with_heads(documents(spark, d), [elf_sample(x) for x in ELF_SECTIONS])
    return fileformat.sections(i).select("image_id", "section_idx", "name", "virtual_size", "raw_size", "sha256", "flags")


def f11_import_sets(spark, d):
    i = importers(spark, d)
    rows = fileformat.section(i, _pairs(i), DEFAULT)
    return rows.select("pair_id", *[F.concat_ws(",", f"imports_{k}").alias(k) for k in ("common", "only_a", "only_b")], r6("similarity_percent").alias("similarity"))


def f13_format_score(spark, d):
    i = executables(spark, d)
    return fileformat.section(i, _pairs_by(i, 4), DEFAULT).select("pair_id", r6("similarity_percent").alias("similarity"))


def a2_module_scores(spark, d):
    i = documents(spark, d)
    rows = scores(compare(i, _pairs(i), SMALL))
    return rows.select("pair_id", "module", "module_ord", "kind", "title", r6("similarity_percent").alias("similarity"))


def _word_counts(images: DataFrame, pairs: DataFrame, opts: CompareOptions) -> DataFrame:
    """A module of a caller's own that fails on payloads beyond ASCII: how alike the numbers of words are."""
    counts = kernel(images, lambda data: [(len(data.decode("ascii").split()),)], {"words": pa.int64()}, "words long", errors=True)
    most = F.greatest("a.words", "b.words")
    score = F.when(most == 0, 100.0).otherwise(100.0 * F.least("a.words", "b.words") / most)
    sides = both_sides(pairs, counts).select("pair_id", score.alias("similarity_percent"), F.coalesce("a.error", "b.error").alias("error"))
    return with_error(sides.withColumn("metrics", metrics(("Words", F.lit("counted")))), F.col("error"))


def a4_error_rows(spark, d):
    """Payloads on which a module fails are error rows of their pairs; other pairs and modules are scored."""
    i = documents(spark, d)
    rows = scores(compare(i, _pairs(i), SMALL.with_values(modules=frozenset({"ByteDiff", "Words"})), {"ByteDiff": bytediff.section, "Words": _word_counts}))
    return rows.select("pair_id", "module", "kind", "title", r6("similarity_percent").alias("similarity"), F.col("error").isNotNull().alias("failed"), F.col("metrics")[0]["Key"].alias("first_metric"))


EDGES = (("none", b"", b""), ("one", b"abc", b""), ("other", b"", b"abcdefghijklmnopqrstuvwxyz"), ("same", b"ab", b"ab"), ("tiny", b"ab", b"cd"), ("null", None, b""))


def edge_rules(spark, d):
    """Empty, null and tiny payloads through every module."""
    rows = [(f"{k}/{s}", v) for k, a, b in EDGES for s, v in (("a", a), ("b", b))]
    i = with_info(spark.createDataFrame(rows, "image_id string, data binary").select("image_id", F.col("image_id").alias("path"), F.coalesce("data", F.lit(b"")).alias("data")))
    p = spark.createDataFrame([(k, f"{k}/a", f"{k}/b") for k, *_ in EDGES], "pair_id string, a_id string, b_id string")
    return scores(compare(i, p)).select("pair_id", "module", r6("similarity_percent").alias("similarity"))


def b10_ranges(spark, d):
    """Powers of two over the line numbers' products, and percentages held within their range."""
    rows = [(x, next_pow2(x)) for x in (*range(-2, 1030), 65_535, 65_536, 65_537, 1 << 30, 1 << 33)]
    return spark.createDataFrame(rows, "x long, power long").select("x", "power", clamp_percent((F.col("x") - 500) / 4).alias("clamped"))


def p3_distinct_cap(spark, d):
    found = patterns.grams(documents(spark, d), DEFAULT.with_values(max_distinct_patterns=20))
    return found.select("image_id", F.hex("gram").alias("hex"), "cnt", "first_offset")


def a7_section_lookup(spark, d):
    i = documents(spark, d)
    found = results(i, _pairs(i), SMALL.with_values(modules=frozenset({"ByteDiff", "Entropy"})))
    return found.select("pair_id", F.col("ByteDiff.total_a").alias("chunks_a"), r6("Entropy.mean_a").alias("mean_a"), r6("Entropy.max_b").alias("max_b"))


def a5_overall(spark, d):
    i = documents(spark, d)
    return overall(i, _pairs(i), SMALL).select("pair_id", r6("overall_percent").alias("overall"))


def a5_weighted_mean(spark, d):
    """The mean's rules on a table of scores: null, failed and unweighted modules leave both sums."""
    base = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("pair_id"),
        F.element_at(F.array(*[F.lit(m) for m in ("ByteDiff", "FuzzyHash", "Format", "Entropy", "Patterns", "Other")]), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("module"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("double")).alias("similarity_percent"),
        F.when(F.col("l_returnflag") == "R", F.lit("failed")).alias("error"),
    )
    opts = CompareOptions(weights={"ByteDiff": 1.0, "FuzzyHash": 2.0, "Format": float("nan"), "Entropy": -1.0, "Patterns": 0.5})
    return weighted_mean(base, opts).select("pair_id", r6("overall_percent").alias("overall"))


def r1_json_fields(spark, d):
    i = documents(spark, d)
    text = to_json(results(i, _pairs(i), CompareOptions(modules=frozenset({"ByteDiff", "Entropy"}), chunk_min=64, chunk_avg=64, chunk_max=256)))
    get = lambda path: F.get_json_object("json", path)
    return text.select(
        "pair_id", get("$.FileA.Name").alias("name_a"), get("$.FileB.Size").cast("long").alias("size_b"), get("$.Sections[0].kind").alias("kind0"),
        get("$.Sections[1].Module").cast("int").alias("module1"), r6(get("$.Sections[0].SimilarityPercent").cast("double")).alias("similarity0"),
        get("$.Sections[0].TotalChunksA").cast("long").alias("chunks_a"), get("$.Sections[1].BlockSize").cast("long").alias("block_size"),
    )


def r3_svg_points(spark, d):
    rows = svg_rows(entropy.profiles(documents(spark, d), DEFAULT))
    return rows.select("image_id", "point", r6("x").alias("x"), r6("y").alias("y"))


def r4_diff_bar(spark, d):
    i = documents(spark, d)
    return span_shares(bytediff.diff_spans(_pairs(i), bytediff.chunks(i, SMALL))).withColumn("width_percent", r6("width_percent"))


def r7_text_bar(spark, d):
    from .plans.report import rendered

    i = documents(spark, d)
    found = results(i, _pairs(i), CompareOptions(modules=frozenset({"Entropy"})))
    return rendered(found, "text").select("pair_id", F.regexp_extract("body", r"(\[[#.]{40}\])", 1).alias("bar"))


def _html(images: DataFrame, pairs: DataFrame, modules: set[str]) -> DataFrame:
    from .plans.report import rendered

    return rendered(results(images, pairs, SMALL.with_values(modules=frozenset(modules))), "html")


def r2_html(spark, d):
    """What a page shows of a pair: score, meter, sections in order, files."""
    i = documents(spark, d)
    pick = lambda pattern: F.regexp_extract("body", pattern, 1)
    every = lambda pattern: F.concat_ws("|", F.regexp_extract_all("body", F.lit(pattern), F.lit(1)))
    return _html(i, _pairs(i), set(DEFAULT.modules)).select(
        "pair_id", F.substring("body", 1, 15).alias("head"), pick("<div class=score>([^<]*)</div>").alias("score"), every("<h2>([^<]*) <small>").alias("sections"),
        every("<b>File [AB]</b>: ([^,]*),").alias("files"), every("SHA256 ([0-9A-F]{64})<").alias("sha256"),
    )


def r5_format_table(spark, d):
    i = with_info(executables(spark, d))
    row = r"<tr><td>([^<]*</td><td>[^<]*</td><td>[^<]*</td><td>[^<]*)</td></tr>"
    rows = F.concat_ws("|", F.transform(F.regexp_extract_all("body", F.lit(row), F.lit(1)), lambda x: F.replace(x, F.lit("</td><td>"), F.lit(","))))
    return _html(i, _pairs_by(i, 4), {"Format"}).select("pair_id", rows.alias("rows"))


def r6_pattern_tables(spark, d):
    i = documents(spark, d)
    cells = F.regexp_extract_all("body", F.lit(r"<tr><td>([0-9A-F]+)</td>"), F.lit(1))
    return _html(i, _pairs(i), {"Patterns"}).select("pair_id", F.size(cells).alias("n_rows"), F.md5(F.concat_ws(",", cells).cast("binary")).alias("digest"))


def _metric_rows(section: DataFrame) -> DataFrame:
    rows = section.select("pair_id", F.posexplode("metrics").alias("k", "m"))
    return rows.select("pair_id", "k", F.col("m.Key").alias("label"), F.col("m.Value").alias("value"))


def r8_fuzzy(spark, d):
    i = documents(spark, d)
    return _metric_rows(fuzzy.section(i, _pairs(i), DEFAULT))


def r8_entropy(spark, d):
    i = documents(spark, d)
    return _metric_rows(entropy.section(i, _pairs(i), DEFAULT))


def r8_patterns(spark, d):
    i = documents(spark, d)
    return _metric_rows(patterns.section(i, _pairs(i), DEFAULT))


def r8_format(spark, d):
    i = executables(spark, d)
    return _metric_rows(fileformat.section(i, _pairs_by(i, 4), DEFAULT))


def r8_metrics(spark, d):
    i = documents(spark, d)
    return _metric_rows(bytediff.section(i, _pairs(i), SMALL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        s2_image_bytes, s3_image_info, s4_size_warning, b1_gear_table, b2_chunks, b5_chunk_jaccard, b6_diff_map, b7_byte_hist, b8_hist_cosine,
        z3_sketch, z4_minhash, z5_block_size, z8_ctph_digest, z9_ctph_score, e1_entropy, e2_block_entropy, e3_downsample, e5_profile_stats,
        e6_profile_similarity, p1_grams, p4_gram_jaccard, p4_gram_join, p5_common_top, p5_hits_by_join, p6_unique_top, p7_pattern_score, p11_hex_spaced, f1_magic, f2_headers,
        f3_sections, f9_section_compare, f11_import_sets, f13_format_score, a2_module_scores, a5_overall, a5_weighted_mean, r1_json_fields,
        r2_html, r3_svg_points, r4_diff_bar, r5_format_table, r6_pattern_tables, r7_text_bar, r8_metrics, r8_fuzzy, r8_entropy, r8_patterns, r8_format,
        a4_error_rows, a7_section_lookup, b10_ranges, edge_rules, f5_imports, f7_elf_sections, p3_distinct_cap,
    )
}

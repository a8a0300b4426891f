"""Reports of comparisons: JSON, text and self-contained HTML, one a pair.

JSON is built by the JVM from the result columns; text and HTML are rendered by a function of
one result row, on the executors, so that any number of pairs can be written.
"""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import MODULES
from .compare import KINDS, TITLES, module_number

#: Hits of each pattern list that HTML shows.
SHOWN_HITS = 25
JSON_OPTIONS = {"ignoreNullFields": "false", "pretty": "true"}


def _file(c: str) -> Column:
    return F.struct(*[F.col(f"{c}.{k}").alias(n) for k, n in (("path", "Path"), ("name", "Name"), ("size", "Size"), ("sha256", "Sha256"))])


def _renamed(x: Column, names: dict[str, str]) -> Column:
    return F.struct(*[x[k].alias(n) for k, n in names.items()])


_HIT = {"hex": "Hex", "count_a": "CountA", "count_b": "CountB", "first_offset_a": "FirstOffsetA", "first_offset_b": "FirstOffsetB"}
_SPAN = {"offset": "Offset", "length": "Length", "shared": "Shared"}
_ENTRY = {"name": "Name", "virtual_size": "VirtualSize", "raw_size": "RawSize", "entropy": "Entropy", "sha256": "Sha256", "flags": "Flags"}


def _summary(x: Column) -> Column:
    plain = {"format": "Format", "machine": "Machine", "time_stamp": "TimeStamp", "subsystem": "Subsystem", "entry_point": "EntryPoint"}
    return F.struct(*[x[k].alias(n) for k, n in plain.items()], F.transform(x["sections"], lambda s: _renamed(s, _ENTRY)).alias("Sections"), x["imports"].alias("Imports"))


def _body(module: str, failed: bool) -> list[Column]:
    """The fields of a module's section besides those all sections have."""
    c = lambda k: F.col(module)[k]
    each = lambda k, names: F.transform(c(k), lambda x: _renamed(x, names))
    if failed:
        return []
    match module:
        case "ByteDiff":
            plain = {"jaccard_percent": "JaccardPercent", "cosine_percent": "HistogramCosinePercent", "common": "CommonChunks", "only_a": "OnlyAChunks", "only_b": "OnlyBChunks", "total_a": "TotalChunksA", "total_b": "TotalChunksB"}
            return [*[c(k).alias(n) for k, n in plain.items()], each("map_a", _SPAN).alias("MapA"), each("map_b", _SPAN).alias("MapB")]
        case "FuzzyHash":
            plain = {"minhash_percent": "MinHashSimilarityPercent", "ctph_percent": "CtphSimilarityPercent", "shingle_k": "ShingleK", "digest_a": "CtphDigestA", "digest_b": "CtphDigestB"}
        case "Format":
            compared = {"name": "Name", "in_a": "InA", "in_b": "InB", "similarity_percent": "SimilarityPercent"}
            imports = {"imports_common": "ImportsCommon", "imports_only_a": "ImportsOnlyA", "imports_only_b": "ImportsOnlyB"}
            return [c("applicable").alias("Applicable"), _summary(c("a")).alias("A"), _summary(c("b")).alias("B"), each("comparisons", compared).alias("SectionComparisons"), *[c(k).alias(n) for k, n in imports.items()]]
        case "Entropy":
            plain = {"block_size": "BlockSize", "mean_a": "MeanEntropyA", "mean_b": "MeanEntropyB", "max_a": "MaxEntropyA", "max_b": "MaxEntropyB", "high_a": "HighEntropyFractionA", "high_b": "HighEntropyFractionB", "profile_a": "ProfileA", "profile_b": "ProfileB"}
        case "Patterns":
            lists = {"common_patterns": "CommonPatterns", "unique_a": "UniqueToA", "unique_b": "UniqueToB"}
            return [c("pattern_length").alias("PatternLength"), *[each(k, _HIT).alias(n) for k, n in lists.items()]]
        case _:
            return []
    return [c(k).alias(n) for k, n in plain.items()]


def section_json(results: DataFrame, module: str) -> Column:
    """A section as JSON text; sections differ in their fields, so each is text before they are joined."""
    c = lambda k: F.col(module)[k]
    bare = set(results.schema[module].dataType.names) == {"similarity_percent", "error", "metrics"}  # the module's plan failed

    def text(failed: bool) -> Column:
        common = [
            F.lit("error" if failed else KINDS.get(module, module)).alias("kind"), F.lit(module_number(module)).alias("Module"),
            F.lit(f"{module} (Error)" if failed else TITLES.get(module, module)).alias("Title"), c("similarity_percent").alias("SimilarityPercent"), c("error").alias("Error"),
        ]
        return F.to_json(F.struct(*common, *_body(module, failed or bare), c("metrics").alias("Metrics")), JSON_OPTIONS)

    return F.when(c("error").isNull(), text(False)).otherwise(text(True))


def modules_of(results: DataFrame) -> list[str]:
    fixed = {"pair_id", "file_a", "file_b", "warnings", "overall_percent", "generated_at"}
    found = [c for c in results.columns if c not in fixed]
    return sorted(found, key=module_number)


def to_json(results: DataFrame) -> DataFrame:
    """``pair_id, json``: PascalCase names, a kind for each section, numbers for modules, nulls kept."""
    field = lambda name, text: F.concat(F.lit(f'  "{name}" : '), text)
    as_json = lambda x: F.to_json(x, JSON_OPTIONS)
    modules = modules_of(results)
    sections = F.concat(F.lit("[ "), F.concat_ws(", ", *[section_json(results, m) for m in modules]), F.lit(" ]")) if modules else F.lit("[ ]")
    stamp = F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    parts = [
        field("FileA", as_json(_file("file_a"))), field("FileB", as_json(_file("file_b"))),
        field("OverallSimilarityPercent", F.col("overall_percent").cast("string")), field("Sections", sections),
        field("GeneratedAt", F.concat(F.lit('"'), stamp, F.lit('"'))), field("Warnings", as_json(F.col("warnings"))),
    ]
    return results.select("pair_id", F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit("\n}")).alias("json"))


def _one_line(x: float | None, digits: int = 2) -> str:
    return "n/a" if x is None else f"{x:.{digits}f} %"


def _short_number(x: float, digits: int) -> str:
    text = f"{x:.{digits}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def text_bar(percent: float, width: int = 40) -> str:
    full = round(min(100.0, max(0.0, percent)) / 100 * width)
    return "[" + "#" * full + "." * (width - full) + "]"


def text_report(row: dict, modules: list[str]) -> str:
    """The console report of one result row."""
    lines = ["", "=== siftmark: similarity analysis ==="]
    for label, f in (("A", row["file_a"]), ("B", row["file_b"])):
        sha = f["sha256"] if len(f["sha256"]) <= 16 else f["sha256"][:16] + "…"
        lines.append(f"{label}: {f['name']}  ({f['size']:,} B)  SHA256 {sha}")
    lines += ["", f"OVERALL SIMILARITY (weighted): {row['overall_percent']:.2f} %", text_bar(row["overall_percent"]), ""]
    for m in modules:
        s = row[m]
        lines.append(f"-- {TITLES.get(m, m) if s['error'] is None else f'{m} (Error)'}  [{_one_line(s['similarity_percent'])}]")
        if s["error"] is not None:
            lines.append(f"   Error: {s['error']}")
            continue
        lines += [f"   {x['Key']:<28} {x['Value']}" for x in s["metrics"]] + [""]
    if row["warnings"]:
        lines += ["Warnings:", *[f"  ! {w}" for w in row["warnings"]]]
    return "\n".join(lines) + "\n"


STYLE = """
:root { --ink: #20242c; --paper: #fbfaf7; --line: #d8d4ca; --a: #2a6fb0; --b: #c2503c; --shared: #3d8f5f; --unique: #b9b4a8 }
body { font: 15px/1.5 system-ui, sans-serif; color: var(--ink); background: var(--paper); max-width: 62rem; margin: 2rem auto; padding: 0 1rem }
section { border-top: 1px solid var(--line); padding: 1rem 0 } table { border-collapse: collapse; width: 100% }
td, th { text-align: left; padding: .2rem .6rem; border-bottom: 1px solid var(--line); vertical-align: top }
.score { font-size: 2.6rem } .meter, .spans { height: 12px; background: var(--line); display: flex } .meter i { background: var(--a) } .mono { font-family: monospace; word-break: break-all }
"""


def svg_points(profile: list[float]) -> list[tuple[float, float]]:
    """A profile's curve in a box 600 wide and 120 high: x by position, y from the bottom for 0 to the top for 8 bits."""
    last = max(1, len(profile) - 1)
    return [(i / last * 600, 120 - min(8.0, max(0.0, v)) / 8 * 120) for i, v in enumerate(profile)]


def entropy_svg(s: dict) -> str:
    paths = []
    for profile, color in ((s["profile_a"], "var(--a)"), (s["profile_b"], "var(--b)")):
        if profile:
            steps = " ".join(f"{'L' if i else 'M'}{_short_number(x, 1)} {_short_number(y, 1)}" for i, (x, y) in enumerate(svg_points(profile)))
            paths.append(f'<path d="{steps}" fill="none" stroke="{color}"/>')
    return f'<svg viewBox="0 0 600 125" width="100%">{"".join(paths)}</svg>'


def span_bar(spans: list[dict]) -> str:
    total = sum(s["length"] for s in spans)
    parts = [f'<i style="width:{_short_number(s["length"] / total * 100, 4)}%;background:var(--{"shared" if s["shared"] else "unique"})"></i>' for s in spans] if total else []
    return f'<div class="spans">{"".join(parts)}</div>'


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = lambda kind, row: "".join(f"<{kind}>{html.escape(str(x))}</{kind}>" for x in row)
    return f"<table><tr>{cells('th', head)}</tr>{''.join(f'<tr>{cells("td", r)}</tr>' for r in rows)}</table>"


def _html_body(module: str, s: dict) -> str:
    if module == "Entropy":
        return entropy_svg(s)
    if module == "ByteDiff":
        return f"<p>File A</p>{span_bar(s['map_a'])}<p>File B</p>{span_bar(s['map_b'])}"
    if module == "Format" and s["applicable"]:
        mark = lambda x: "yes" if x else "no"
        out = _table(["Section", "in A", "in B", "Similarity"], [[c["name"], mark(c["in_a"]), mark(c["in_b"]), _one_line(c["similarity_percent"], 1)] for c in s["comparisons"]])
        for side in "ab":
            if s["imports_only_a"] or s["imports_only_b"]:
                out += f"<p>Imports only in {side.upper()}: {html.escape(', '.join(s[f'imports_only_{side}']))}</p>"
        return out
    if module == "Patterns":
        lists = (("Shared patterns", "common_patterns"), ("Only in A (candidate indicators)", "unique_a"), ("Only in B (candidate indicators)", "unique_b"))
        return "".join(f"<p>{t} ({len(s[k])})</p>" + _table(["Hex", "A", "B"], [[h["hex"], h["count_a"], h["count_b"]] for h in s[k][:SHOWN_HITS]]) for t, k in lists)
    return ""


def html_report(row: dict, modules: list[str]) -> str:
    """A self-contained page of one result row; all text is escaped."""
    e = html.escape
    files = "".join(f"<div><b>File {x}</b>: {e(f['name'])}, {f['size']:,} bytes<div class=mono>SHA256 {e(f['sha256'])}</div></div>" for x, f in (("A", row["file_a"]), ("B", row["file_b"])))
    warned = "".join(f"<p>⚠ {e(w)}</p>" for w in row["warnings"] or [])
    percent = row["overall_percent"]
    out = [
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Similarity report</title><style>{STYLE}</style></head><body>',
        f"<h1>Similarity analysis</h1><p>Created: {row['generated_at']:%Y-%m-%d %H:%M:%S}</p><div class=score>{percent:.2f} %</div><p>Weighted overall similarity</p>",
        f'<div class="meter"><i style="width:{_short_number(min(100.0, max(0.0, percent)), 2)}%"></i></div>{files}{warned}',
    ]
    for m in modules:
        s = row[m]
        score = "not scored" if s["similarity_percent"] is None else _one_line(s["similarity_percent"])
        out.append(f"<section><h2>{e(TITLES.get(m, m) if s['error'] is None else f'{m} (Error)')} <small>{score}</small></h2>")
        if s["error"] is not None:
            out.append(f"<p>Error: {e(s['error'])}</p></section>")
            continue
        out.append("<table>" + "".join(f"<tr><th>{e(x['Key'])}</th><td class=mono>{e(x['Value'])}</td></tr>" for x in s["metrics"]) + f"</table>{_html_body(m, s)}</section>")
    return "".join(out) + "</body></html>"


def rendered(results: DataFrame, form: str) -> DataFrame:
    """``pair_id, body`` of every pair as "html" or "text", rendered on the executors."""
    modules = modules_of(results)
    render = {"html": html_report, "text": text_report}[form]
    id_type = results.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column("pair_id"), pa.array([render(r, modules) for r in part.to_pylist()])], names=["pair_id", "body"])

    return results.mapInArrow(run, f"pair_id {id_type}, body string")


def write_reports(results: DataFrame, folder: str, form: str) -> None:
    """One line of JSON, or one file's text, a pair: a table by pair_id at any number of pairs."""
    frame = to_json(results).withColumnRenamed("json", "body") if form == "json" else rendered(results, form)
    frame.write.mode("overwrite").parquet(folder)


def span_shares(spans: DataFrame) -> DataFrame:
    """``pair_id, side, offset, width_percent, shared``: the diff bar as rows."""
    from pyspark.sql import Window

    total = F.sum("length").over(Window.partitionBy("pair_id", "side"))
    return spans.select("pair_id", "side", "offset", (100.0 * F.col("length") / total).alias("width_percent"), "shared")


def svg_rows(profiles: DataFrame) -> DataFrame:
    """``image_id, point, x, y`` of each profile's curve, by the same rule as :func:`svg_points`."""
    last = F.greatest(F.size("profile") - 1, F.lit(1))
    points = profiles.select("image_id", last.alias("last"), F.posexplode("profile").alias("point", "v"))
    y = 120 - F.greatest(F.lit(0.0), F.least(F.lit(8.0), F.col("v"))) / 8 * 120
    return points.select("image_id", "point", (F.col("point") / F.col("last") * 600).alias("x"), y.alias("y"))


def check_json(text: str) -> dict:
    """A JSON report read back; numbers that are not finite come as strings."""
    return json.loads(text, parse_constant=lambda name: math.nan if name == "NaN" else math.inf)


__all__ = ["MODULES", "check_json", "html_report", "rendered", "span_shares", "svg_rows", "text_report", "to_json", "write_reports"]

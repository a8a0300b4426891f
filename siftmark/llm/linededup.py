"""Operator 2: site-relative line deduplication.  DataFrame functions only.

Within each host the pages that hold a line are divided by all its pages; lines above
the boilerplate ratio, on ``min_pages`` pages at least, are dropped.  A host's dropped
lines are fewer than its mean lines a page over the ratio, so a host's set of them stays
small whatever the host's size, and is joined back by host without exploding lines again.

Defined results: lines are compared without surrounding blanks, by a 64-bit hash; blank lines are
never dropped; null text stays null and holds no lines, but counts as a page; a null host
is one host; rows that repeat count as pages of their own, or with ``copies_once`` a host's
equal texts count as one page; texts whose lines all go become empty; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Parts of a page that show no text, and tags that end a line.
HIDDEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
BLOCK_TAG = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>"
ANY_TAG = r"<[^<>]*>"
BLANKS = " \t\r\x0b\x0c"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column | str) -> Column:
    """The visible lines of a page: hidden parts out, block tags as line ends, entities resolved.

    Every step is linear in the page's length: what is left open is hidden to the page's end, a tag
    ends at the next angle bracket, and blanks are trimmed line by line.
    """
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK_TAG, "\n")
    lines = F.split(F.regexp_replace(text, ANY_TAG, ""), "\n")
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), "\n")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.btrim(text, F.lit("\n "))


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def _key(line: Column) -> Column:
    """Identity of a line: null for a blank one."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def drop_boilerplate(pages: DataFrame, id_col: str, host_col: str, text_col: str, ratio: float = 0.05, min_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text_col``, and ``lines_in``, ``lines_dropped`` where these names are free.

    With ``copies_once`` whole copies don't make their lines frequent, so none of them goes blank for being copied.
    """
    # the row travels as one struct: its column names can't clash with those made here
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.split(text_col, "\n").alias("_lines"), F.col(host_col).alias("_host"))
    host, text = F.col(host_col).alias("_host"), F.xxhash64(text_col).alias("_text")
    keys = F.array_distinct(F.transform(F.split(text_col, "\n"), _key))
    counted, lines = pages.select(host, text), pages.select(host, text, F.explode(keys).alias("_key")).filter("_key is not null")
    if copies_once:  # numbers alone meet: a text's lines are told apart by its hash
        counted, lines = counted.distinct(), lines.distinct()
    totals = counted.groupBy("_host").agg(F.count("*").alias("_pages"))
    held = lines.groupBy("_host", "_key").agg(F.count("*").alias("_held")).filter(F.col("_held") >= min_pages)
    totals = stored(totals, "hosts")
    common = held.join(totals, held["_host"].eqNullSafe(totals["_host"])).filter(F.col("_held") > ratio * F.col("_pages"))
    # at most mean lines a page / ratio keys a host
    drop = stored(common.groupBy(held["_host"]).agg(F.collect_set("_key").alias("_drop")), "boilerplate")
    joined = base.join(drop, base["_host"].eqNullSafe(drop["_host"]), "left").drop(drop["_host"])
    kept = F.filter("_lines", lambda line: ~F.coalesce(F.array_contains("_drop", _key(line)), F.lit(False)))
    joined = joined.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept))
    none = F.col("_lines").isNull()
    made = {
        "lines_in": F.when(none, 0).otherwise(F.size("_lines")),
        "lines_dropped": F.when(none, 0).otherwise(F.size("_lines") - F.size("_kept")),
    }
    columns = [F.array_join("_kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in pages.columns]
    return joined.select(*columns, *[v.alias(k) for k, v in made.items() if k not in pages.columns])


def page_line_dedup(pages: DataFrame, ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """``page_id, host, text, lines_in, lines_dropped`` of html pages."""
    text = stored(pages.select("page_id", url_host("url").alias("host"), html_text("html").alias("text")), "pages_text")
    return drop_boilerplate(text, "page_id", "host", "text", ratio, min_pages)

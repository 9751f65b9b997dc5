"""Cleaning of extracted pages: running headers and footers, printed tables of contents, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx


def edge_keys(lines: DataFrame, edge: int = 3) -> DataFrame:
    """Adds e_key and n_key (null off the page's edges), outer, and pages (of the document), to lines
    (doc_id, page, line_no, line). A page's first and last ``edge`` lines are its edge; its very first and
    last are outer; only short ones of those have a number key."""
    up = Window.partitionBy("doc_id", "page").orderBy("line_no")
    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("line_no"))
    d = lines.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down))
    d = d.withColumn("outer", (F.col("_a") == 1) | (F.col("_b") == 1))
    at_edge = (F.col("_a") <= edge) | (F.col("_b") <= edge)
    short = F.size(tx.words(F.col("line"))) <= 10
    e, n = tx.exact_key(F.col("line")), tx.number_key(F.col("line"))
    d = d.withColumn("e_key", F.when(at_edge & (e != ""), e)).withColumn("n_key", F.when(F.col("outer") & short & (n != ""), n))
    d = d.withColumn("n_all", F.when(F.col("outer"), n))
    return d.drop("_a", "_b")


def headers_footers(lines: DataFrame, edge: int = 3, least_pages: int = 4) -> DataFrame:
    """Adds dropped: lines that run along the edges of many pages of their document, alike or but for their
    numbers, and bare page numbers. Documents of fewer than ``least_pages`` pages keep all lines."""
    d = edge_keys(lines, edge)
    pages = d.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    limit = F.greatest(F.lit(3), F.floor(F.lit(0.08) * F.col("pages")))
    often = lambda key, name: d.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.countDistinct("page").alias(name))
    numbers = often("n_key", "n_pages").withColumnRenamed("n_key", "n_all")
    j = d.join(pages, "doc_id").join(often("e_key", "e_pages"), ["doc_id", "e_key"], "left").join(numbers, ["doc_id", "n_all"], "left")
    exact = F.coalesce(F.col("e_pages") >= limit, F.lit(False))
    number = F.col("outer") & (F.coalesce(F.col("n_pages") >= limit, F.lit(False)) | F.coalesce(F.col("n_all") == "#", F.lit(False)))
    return j.withColumn("dropped", (F.col("pages") >= least_pages) & (exact | number)).select(*lines.columns, "dropped")


# Fixed value, a pattern: a line that ends in dot leaders or a wide gap, and a page number.
LEADER = r"(\.\s?){4,}\s*[0-9ivxlcIVXLC]+\s*$|\s{3,}[0-9]+\s*$"


def toc_pages(lines: DataFrame, ratio: float = 0.4) -> DataFrame:
    """(doc_id, page, hits, lines) of pages with five lines or more, of which ``ratio`` end like entries."""
    g = lines.where(F.trim("line") != "").groupBy("doc_id", "page")
    out = g.agg(F.count_if(F.col("line").rlike(LEADER)).alias("hits"), F.count("*").alias("lines"))
    return out.where((F.col("lines") >= 5) & (F.col("hits") >= ratio * F.col("lines")))


def clean(lines: DataFrame) -> DataFrame:
    """lines without running headers and footers, then without printed tables of contents."""
    kept = headers_footers(lines).where(~F.col("dropped")).drop("dropped")
    return kept.join(toc_pages(kept).select("doc_id", "page"), ["doc_id", "page"], "left_anti")


# Fixed values, patterns: words that begin a unit, so "3.3 V supply" is no heading; a heading by keyword, and by number.
_UNIT = r"^(?:ns|ps|us|µs|ms|s|mV|V|mA|A|W|mW|kHz|MHz|GHz|Hz|kbps|Mbps|Gbps|Gb/s|Mb/s|GT/s|ohm|Ω|pF|nF|uF|dB|mm|mil|bits?|bytes?|UI|%)\b"

_KEYWORD = r"(?i)^(?:Chapter|Section|Appendix|Annex|Attachment|Part)\s+([A-Z0-9]{1,3}(?:\.\d{1,3})*)\s*[.:\-–—]?\s*([^\n]{0,118})$"
_NUMBERED = r"^((?:\d{1,2}|[A-Z])(?:\.\d{1,3}){0,7})\.?\s{1,6}([A-Z][^\n]{1,118})$"


def heading(line: Column, alone: Column) -> Column:
    """struct(level, title) if a line is a heading, else null: '# ...' marks, keywords with a number, or
    section numbers before a capitalised title that is neither a sentence, nor a table row, nor a value."""
    x = F.trim(line)
    marks = F.regexp_extract(x, r"^(#{1,6})\s+(.+)$", 1)
    marked = F.trim(F.regexp_extract(x, r"^(#{1,6})\s+(.+)$", 2))
    keyword, numbered = _KEYWORD, _NUMBERED
    dots = lambda n: F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    kw, num, title = F.regexp_extract(x, keyword, 1), F.regexp_extract(x, numbered, 1), F.trim(F.regexp_extract(x, numbered, 2))
    plain = dots(num) == 0
    digits = F.length(title) - F.length(F.regexp_replace(title, "[0-9]", ""))
    fine = (
        (num != "") & ~(plain & num.rlike("^[A-Z]$")) & ~title.rlike(r"[.,;]$") & (F.size(tx.words(title)) <= 16)
        & (digits <= 0.3 * F.length(title)) & (~plain | (alone & (F.coalesce(num.try_cast("int"), F.lit(99)) <= 40))) & ~title.rlike(_UNIT)
    )
    make = lambda level, t: F.struct(level.cast("int").alias("level"), t.alias("title"))
    usable = (x != "") & (F.length(x) <= 130)
    return (
        F.when(~usable, None).when(marks != "", make(F.length(marks), marked))
        .when((kw != "") & alone & ~x.endswith("."), make(dots(kw) + 1, x))
        .when(fine, make(dots(num) + 1, F.concat(num, F.lit(" "), title)))
    )


def section_stack(blocks: DataFrame, by: list[str], order: str, level: str = "level", title: str = "title", deepest: int = 8) -> DataFrame:
    """Adds section, the titles of the headings that hold at each block: the last heading of every level, as
    long as no shallower one came after it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col(level) == k, F.col(order)), True).over(w) for k in range(1, deepest + 1)]
    name = [F.last(F.when(F.col(level) == k, F.col(title)), True).over(w) for k in range(1, deepest + 1)]
    d = blocks.withColumns({f"_a{k}": a for k, a in enumerate(at, 1)} | {f"_t{k}": t for k, t in enumerate(name, 1)})
    parts = []
    for k in range(1, deepest + 1):
        last_up = F.greatest(*[F.coalesce(F.col(f"_a{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)
        parts.append(F.when(F.col(f"_a{k}") > last_up, F.col(f"_t{k}")))
    section = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return d.withColumn("section", section).select(*blocks.columns, "section")


def section_label(section: Column, depth: int = 3) -> Column:
    return F.array_join(F.slice(section, F.greatest(F.lit(1), F.size(section) - depth + 1), F.lit(depth)), " > ")

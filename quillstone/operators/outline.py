"""Sections of a document from its outline, where that is fine enough, else from its headings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.cleaning import section_stack

# Fixed values, a pattern: what stands before a title as its number.
_NUMBER = r"^(?:(?:chapter|section|appendix|annex|part|clause)\s+)?(?:[a-z]\s)?(?:\d+\s)*"
#: Characters of a title that are compared, and by how many a heading's line may be longer.
HEAD = 60
LONGER = 30
#: Lines of a block that may be headings, and letters that the beginning of a broken title needs.
LINES = 4
BROKEN = 12


def plain(text: Column) -> Column:
    """Letters and digits, in lower case, single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def names(line: Column, title: Column) -> Column:
    """A line prints a title of the outline, with or without its number, perhaps only its beginning, where it goes on in the next line."""
    a, b = plain(line), plain(title)
    begins = lambda x, y: F.startswith(x, F.substring(y, 1, HEAD)) | ((F.length(x) >= BROKEN) & F.startswith(y, x))
    x, y = (F.trim(F.regexp_replace(c, _NUMBER, "")) for c in (a, b))
    return (a != "") & (b != "") & (F.length(a) <= F.length(b) + LONGER) & (begins(a, b) | ((F.length(x) >= 4) & (F.length(y) >= 4) & begins(x, y)))


def usable(outline: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id of documents (doc_id, n_pages, docx) whose outline (doc_id, level, ...) is used: three entries or more, of two levels or
    one for every ten pages; never those of a format that marks its own headings."""
    n = outline.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("level").alias("deepest")).where("n >= 3")
    return n.join(documents.where("not docx"), "doc_id").where((F.col("deepest") >= 2) | (F.col("n") * 10 >= F.col("n_pages"))).select("doc_id")


def aligned(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, nth, ordinal): the block in which each entry of an outline begins to hold, null behind the last one.

    outline: doc_id, nth, level, title, page. blocks: doc_id, ordinal, page, text, table. Entries hold in order of page and
    nth, each at or after the one before: at the block of its page whose line prints it (one of the block's first lines, each line
    right behind one that printed another), else where its page ends. So a title that is printed again on a
    page of contents, or earlier, is not taken, and skipped entries begin with the next that is found.

    Lines meet entries by document and page, and which of them agree is decided by expressions; only agreeing numbers
    reach the fold over a document, which holds its entries and blocks, not its text."""
    e = outline.select("doc_id", "nth", "title", "page")
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, LINES)
    b = blocks.select("doc_id", "ordinal", "page", F.when(F.col("table"), F.array().cast("array<string>")).otherwise(lines).alias("lines"))
    each = b.select("doc_id", "ordinal", "page", F.posexplode("lines").alias("line", "text"))
    met = each.join(e, ["doc_id", "page"]).where(names(F.col("text"), F.col("title"))).select("doc_id", "ordinal", "line", "nth")
    every = b.select("doc_id", "ordinal", "page", F.lit(-1).alias("line"), F.lit(None).cast("long").alias("nth")).unionByName(
        met.select("doc_id", "ordinal", F.lit(None).cast("long").alias("page"), F.col("line").cast("int").alias("line"), F.col("nth").cast("long").alias("nth"))
    )

    def run(key, entries: pa.Table, rows: pa.Table) -> pa.Table:
        order = sorted(zip(entries.column("page").to_pylist(), entries.column("nth").to_pylist(), strict=True))
        agree: dict[tuple[int, int], set[int]] = {}
        pages: list[tuple[int, int]] = []
        for o, page, line, nth in zip(*(rows.column(c).to_pylist() for c in ("ordinal", "page", "line", "nth")), strict=True):
            if line < 0:
                pages.append((o, page))
            else:
                agree.setdefault((o, line), set()).add(nth)
        begins: list[int | None] = [None] * len(order)
        at = 0
        for o, page in sorted(pages):
            while at < len(order) and order[at][0] < page:
                begins[at], at = o, at + 1
            for line in range(LINES):
                hit = next((j for j in range(at, len(order)) if order[j][0] == page and order[j][1] in agree.get((o, line), ())), None)
                if hit is None:
                    break
                begins[at : hit + 1], at = [o] * (hit + 1 - at), hit + 1
        ids = entries.column("doc_id").to_pylist()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "nth": pa.array([n for _, n in order], pa.int64()), "ordinal": pa.array(begins, pa.int64())})

    left = e.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("nth").cast("long").alias("nth"), F.col("page").cast("long").alias("page"))
    right = every.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("page").cast("long").alias("page"), "line", "nth")
    return left.groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInArrow(run, "doc_id long, nth long, ordinal long")


def sections(outline: DataFrame, blocks: DataFrame, documents: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, ordinal, section, by_outline): titles that hold at every block, from the outline of the documents in which that is
    usable, else from headings (doc_id, ordinal, level, title) of the blocks. A block's last heading is the one that counts."""
    good = usable(outline, documents)
    fine = aligned(outline.join(good, "doc_id", "left_semi"), blocks.join(good, "doc_id", "left_semi")).where("ordinal is not null")
    titles = outline.select("doc_id", "nth", "page", "level", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))
    starts = fine.join(titles, ["doc_id", "nth"]).select("doc_id", "ordinal", F.col("page").alias("_p"), F.col("nth").alias("_k"), "level", "title", F.lit(True).alias("by_outline"))
    found = headings.join(good, "doc_id", "left_anti").select("doc_id", "ordinal", F.lit(0).alias("_p"), F.lit(0).alias("_k"), "level", "title", F.lit(False).alias("by_outline"))
    own = blocks.join(good.withColumn("by_outline", F.lit(True)), "doc_id", "left").select("doc_id", "ordinal", F.coalesce("by_outline", F.lit(False)).alias("by_outline"))
    # Entries that begin in a block come before it; the order of both is one number.
    events = starts.unionByName(found).withColumn("_block", F.lit(0)).unionByName(own.select("doc_id", "ordinal", F.lit(None).cast("long").alias("_p"), F.lit(None).cast("long").alias("_k"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"), "by_outline", F.lit(1).alias("_block")))
    order = Window.partitionBy("doc_id").orderBy("ordinal", "_block", "_p", "_k")
    stacked = section_stack(events.withColumn("_at", F.row_number().over(order)), ["doc_id"], "_at")
    return stacked.where("_block = 1").select("doc_id", "ordinal", "section", "by_outline")

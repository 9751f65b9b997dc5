"""Lines, pages, chunks and sections of the documents table: page, ordinal and section follow from the
line's number, as fixed-size stand-ins for what a parser finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.catalog import read


def lines(spark, sf: str) -> DataFrame:
    """(doc_id, lang, source, line_no, line, page, ordinal, section)."""
    d = read(spark, sf, "documents")
    each = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    no = F.col("at").cast("long") + 1
    ordinal = F.floor((no - 1) / 5)
    return each.select("doc_id", "lang", "source", no.alias("line_no"), "line", (F.floor((no - 1) / 40) + 1).alias("page"), ordinal.alias("ordinal"), F.floor(ordinal / 4).alias("section"))


LINES = """lines AS (
  SELECT doc_id, lang, source, line_no, line, (line_no-1)//40 + 1 AS page, (line_no-1)//5 AS ordinal, (line_no-1)//20 AS section
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents))"""


def _pieces(spark, sf: str) -> DataFrame:
    """(doc_id, lang, source, n, pieces): a document's lines, five to a piece. Built within its row: no shuffle."""
    d = read(spark, sf, "documents")
    parts = F.split("text", "\n")
    n = F.size(parts)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 5).cast("int")), lambda i: F.array_join(F.slice(parts, i * 5 + 1, F.lit(5)), "\n"))
    return d.select("doc_id", "lang", "source", n.alias("n"), pieces.alias("pieces"))


def chunks(spark, sf: str) -> DataFrame:
    """(doc_id, lang, source, ordinal, section, page_start, page_end, text): five lines each."""
    each = _pieces(spark, sf).select("doc_id", "lang", "source", "n", F.posexplode("pieces").alias("at", "text"))
    at = F.col("at").cast("long")
    return each.select("doc_id", "lang", "source", at.alias("ordinal"), F.floor(at / 4).alias("section"), (F.floor(at * 5 / 40) + 1).alias("page_start"), (F.floor(F.least(at * 5 + 4, F.col("n") - 1) / 40) + 1).alias("page_end"), "text")


def blocks(spark, sf: str) -> DataFrame:
    """(doc_id, blocks): the same pieces as an array of (page, text, kind, section), in order."""
    block = lambda t, i: F.struct((F.floor(i * 5 / 40) + 1).cast("int").alias("page"), t.alias("text"), F.lit("text").alias("kind"), F.concat(F.lit("S"), F.floor(i / 4).cast("string")).alias("section"))
    return _pieces(spark, sf).select("doc_id", F.transform("pieces", block).alias("blocks"))


CHUNKS = (
    LINES
    + """, chunks AS (
  SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, ordinal, any_value(section) AS section, min(page) AS page_start,
         max(page) AS page_end, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, ordinal)"""
)

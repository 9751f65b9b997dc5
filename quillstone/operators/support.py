"""The fewest parts of a source that carry a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions.units import find_quantities, same, table_quantities

_CHOSEN = "array<struct<unit_id:bigint,score:double,numbers:array<string>>>"


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(tx.terms(text), lambda t: F.length(t) > 3))


def _technical(text: Column) -> Column:
    """Words with two capitals or more, in lower case: symbols, names of registers."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b\w*[A-Z]\w*[A-Z]\w*\b"), F.lit(0)), F.lower))


def _printed(kind: Column, text: Column, header: Column) -> Column:
    """A row below its table's head, so that it takes the units of its columns."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    head = F.concat(line(header), line(F.transform(header, lambda _: F.lit("---"))))
    return F.when((kind == "row") & (F.size(header) > 0), F.concat(head, text)).otherwise(text)


def cover(claims: DataFrame, units: DataFrame, most: int = 3) -> DataFrame:
    """(claim_id, nth, unit_id, score, numbers): units of its source that carry a claim, ``most`` at most; numbers are those of
    the claim that a unit adds, as the source writes them.

    claims: claim_id, doc_id, text. units: doc_id, unit_id, kind (text, row, header), text, header (cells).
    A unit scores three for each number of the claim that it writes, or states as the same quantity in another unit, one for
    each technical term, and the share of the claim's words. The best one is taken, then others only while they state
    numbers that are still missing. A claim without numbers is carried by its words (two fifths of them), by two technical terms, or
    by its only one; if two different units do that equally well, by none. Ties go to the smaller unit_id."""
    bare = F.regexp_replace("text", tx.CITATION, " ")
    a = claims.select("claim_id", "doc_id", F.array_distinct(tx.bare_numbers(F.col("text"))).alias("_n"), _words(bare).alias("_w"), _technical(bare).alias("_t"), find_quantities(bare).alias("_q"))
    u = units.select("doc_id", "unit_id", "kind", F.col("text").alias("_text"), F.coalesce("header", F.array().cast("array<string>")).alias("_h"))
    u = u.select(*u.columns, F.array_distinct(tx.bare_numbers(F.col("_text"))).alias("_un"), _words(F.col("_text")).alias("_uw"), _technical(F.col("_text")).alias("_ut"), find_quantities(F.col("_text")).alias("_uq"), table_quantities(_printed(F.col("kind"), F.col("_text"), F.col("_h"))).alias("_uc"))
    both = a.join(u, "doc_id").where((F.col("kind") != "header") | (F.size("_n") > 0))

    def written(n: Column) -> Column:
        """How the unit writes a number of the claim, null if it doesn't."""
        asked = F.filter("_q", lambda q: q["number"] == n)
        alike = F.filter(F.concat("_uq", "_uc"), lambda x: F.array_contains("_un", x["number"]) & F.exists(asked, lambda q: same(q, x)))
        return F.when(F.array_contains("_un", n), n).otherwise(F.get(alike, F.lit(0))["number"])

    hits = F.filter(F.transform("_n", lambda n: F.struct(n.alias("said"), written(n).alias("written"))), lambda x: x["written"].isNotNull())
    shared = F.size(F.array_intersect("_t", "_ut"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("_w", "_uw")).cast("double"), F.size("_w")), F.lit(0.0))
    s = both.select("claim_id", "unit_id", "_text", "_n", hits.alias("_hits"), shared.alias("_shared"), share.alias("_share"), F.size("_t").alias("_terms"))
    worded = (F.col("_share") >= 0.4) | (F.col("_shared") >= 2) | ((F.col("_shared") == 1) & (F.col("_terms") == 1))
    s = s.where(F.when(F.size("_n") > 0, F.size("_hits") > 0).otherwise(worded))
    score = F.round(3.0 * F.size("_hits") + F.col("_shared") + F.col("_share"), 6)
    g = s.groupBy("claim_id").agg(F.first("_n").alias("n"), F.array_sort(F.collect_list(F.struct((-score).alias("minus"), F.col("unit_id").cast("long").alias("unit_id"), F.col("_text").alias("text"), F.col("_hits").alias("hits")))).alias("us"))
    rival = F.get("us", F.lit(1))
    tie = (F.size("n") == 0) & F.coalesce((rival["minus"] == F.get("us", F.lit(0))["minus"]) & (rival["text"] != F.get("us", F.lit(0))["text"]), F.lit(False))
    start = F.struct(F.array().cast(_CHOSEN).alias("chosen"), F.array().cast("array<string>").alias("covered"))

    def step(state: Column, x: Column) -> Column:
        chosen, covered = state["chosen"], state["covered"]
        new = F.filter(x["hits"], lambda h: ~F.array_contains(covered, h["said"]))
        full = (F.size(chosen) >= most) | ((F.size(chosen) > 0) & (F.size(new) == 0))
        one = F.struct(x["unit_id"].alias("unit_id"), (-x["minus"]).alias("score"), F.transform(new, lambda h: h["written"]).alias("numbers"))
        more = F.struct(F.concat(chosen, F.array(one)).alias("chosen"), F.concat(covered, F.transform(new, lambda h: h["said"])).alias("covered"))
        return F.when(full, state).otherwise(more)

    picked = F.aggregate("us", start, step, lambda x: x["chosen"])
    return g.where(~tie).select("claim_id", F.posexplode(picked).alias("nth", "_c")).select("claim_id", "nth", "_c.unit_id", "_c.score", "_c.numbers")

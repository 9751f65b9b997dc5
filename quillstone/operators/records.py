"""Quality records of processed documents, retries, clause links of errata, and tables that two readers found on a page."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Faults that another try may mend, and a reference to a numbered clause.
PARTIAL = ["vlm_failed", "metadata_failed"]
#: Documents of a task in a retry.
DOCUMENTS = 50_000
CLAUSE = r"(?i)(?:section|clause|§|sec\.)\s*(\d+(?:\.\d+)+)"


def quality(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, status, stage, failed_pages, index_kept, last_ok_at, needs_reprocess) of documents (doc_id, stage, processed_at,
    indexed_at, last_ok_at) with issues (doc_id, code, page).

    A document with a stage did not get through it: it failed, what was indexed before stays, and the last time that it was fine
    is kept. Else it is partial if a fault of PARTIAL is among its issues, or ok."""
    bad = issues.where(F.col("code").isin(*PARTIAL)).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    d = documents.join(bad, "doc_id", "left")
    failed = F.coalesce("stage", F.lit("")) != ""
    status = F.when(failed, "failed").when(F.col("pages").isNotNull(), "partial").otherwise("ok")
    return d.select(
        "doc_id", status.alias("status"), F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("pages", F.array().cast(d.schema["pages"].dataType)).alias("failed_pages"),
        (failed & F.col("indexed_at").isNotNull()).alias("index_kept"), F.when(failed, F.coalesce("last_ok_at", "indexed_at")).otherwise(F.col("processed_at")).alias("last_ok_at"), (status != "ok").alias("needs_reprocess"),
    )


def retry(pages: DataFrame, again: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages as they stand after the retry, with the result of their document, (doc_id, scope, result, still_failed)).

    pages and again: doc_id, page, failed, content. records: doc_id, status, one for each document. A document that was partial has its
    failed pages replaced only, by what the retry has of them; one that failed as a whole takes all of the retry's. A retry after which more
    pages fail than before is refused as a whole, unless the whole document had failed: its pages stay, result kept_existing. Otherwise the
    result is ok or partial. Documents without a retry, or in good order, stay as they are and have no result.

    Pages, retries and records lie together by document, in tasks of DOCUMENTS at most, and are sorted once."""
    side = lambda d, n, *cols: d.select("doc_id", *[c.alias(k) for k, c in zip(("page", "failed", "content", "status"), cols, strict=True)], F.lit(n).alias("_side"))
    kinds = {k: pages.schema[k].dataType for k in ("page", "failed", "content")}
    own = [F.col(k) for k in kinds]
    rows = side(pages, 0, *own, F.lit(None).cast("string")).unionByName(side(again, 1, *own, F.lit(None).cast("string")))
    rows = rows.unionByName(side(records, 2, *[F.lit(None).cast(t) for t in kinds.values()], F.col("status")))
    rows = rows.withColumn("_apart", F.when(F.col("page").isNull(), F.col("_side")))  # pages without a number don't meet
    spark = pages.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(records.count() / DOCUMENTS)), "doc_id")

    spot, whole = Window.partitionBy("doc_id", "page", "_apart"), Window.partitionBy("doc_id")
    given = F.struct(F.col("failed").alias("f"), F.col("content").alias("c"))
    met = rows.withColumn("_with", F.collect_list(F.when(F.col("_side") == 1, given)).over(spot)).withColumn("_had", F.max(F.col("_side") == 0).over(spot))
    met = met.withColumn("status", F.max("status").over(whole)).withColumn("_again", F.max(F.col("_side") == 1).over(whole))
    tried = F.coalesce(F.col("doc_id").isNotNull() & F.col("_again") & (F.col("status") != "ok"), F.lit(False))
    met = met.withColumn("_tried", tried).where((F.col("_side") == 0) | ((F.col("_side") == 1) & F.col("_tried") & ~F.col("_had")))
    old = F.col("_side") == 0
    with_ = F.when(~old, F.array(given)).when(F.col("_tried") & (F.size("_with") > 0), F.col("_with")).otherwise(F.array(F.when(F.lit(False), given)))
    after = met.select("doc_id", "page", "status", "_tried", old.alias("had"), F.when(old, F.col("failed")).alias("failed"), F.when(old, F.col("content")).alias("content"), F.explode(with_).alias("_x"))

    new, lost = F.col("_x").isNotNull(), F.col("status") == "failed"
    takes = new & (lost | F.coalesce("failed", F.lit(True)))
    after = after.withColumn("f2", F.when(takes, F.col("_x.f")).otherwise(F.col("failed"))).withColumn("c2", F.when(takes, F.col("_x.c")).otherwise(F.col("content"))).withColumn("gone", lost & ~new)
    after = after.withColumn("before", F.count_if("failed").over(whole)).withColumn("now", F.count_if(F.col("f2") & ~F.col("gone")).over(whole))
    after = after.withColumn("refused", ~lost & (F.col("now") > F.col("before")))
    result = F.when(F.col("_tried"), F.when(F.col("refused"), "kept_existing").when(F.col("now") > 0, "partial").otherwise("ok"))
    after = after.withColumn("result", result)
    failing = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("page"))))
    n = after.where("_tried").groupBy("doc_id").agg(F.first("status").alias("_s"), F.first("result").alias("result"), failing(F.col("f2") & ~F.col("gone")).alias("bad"), failing(F.col("failed")).alias("old"))
    report = n.select("doc_id", F.when(F.col("_s") == "failed", "document").otherwise("pages").alias("scope"), "result", F.when(F.col("result") == "kept_existing", F.col("old")).otherwise(F.col("bad")).alias("still_failed"))
    stays = ~F.col("_tried") | F.when(F.col("refused"), F.col("had")).otherwise(~F.col("gone"))
    asis = ~F.col("_tried") | F.col("refused")
    merged = after.where(stays).select("doc_id", "page", F.when(asis, F.col("failed")).otherwise(F.col("f2")).alias("failed"), F.when(asis, F.col("content")).otherwise(F.col("c2")).alias("content"), "result")
    return merged, report


def clause_links(errata: DataFrame, amends: DataFrame, passages: DataFrame) -> DataFrame:
    """(erratum, clause, passage): passages of the documents that an erratum amends and whose section is a clause that it names, or lies in one.

    errata: erratum, doc_id, text. amends: doc_id, base_id. passages: passage, doc_id, section (titles joined by ' > '). Every
    title's leading number is exploded into itself and what it lies in (4.2.1: 4, 4.2, 4.2.1), so clauses meet passages by
    equality of document and number. Each link once."""
    named = errata.select("erratum", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CLAUSE), F.lit(1)))).alias("clause"))
    named = named.join(amends, "doc_id").select("erratum", "clause", F.col("base_id").alias("doc_id"))
    numbers = F.filter(F.transform(F.split("section", " > "), lambda t: F.regexp_extract(t, r"^(\d+(?:\.\d+)*)(?![\w])", 1)), lambda x: x != "")

    def within(number: Column) -> Column:
        parts = F.split(number, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))

    held = passages.where("section is not null").select("passage", "doc_id", F.explode(F.array_distinct(F.flatten(F.transform(numbers, within)))).alias("clause"))
    return named.join(held, ["doc_id", "clause"]).select("erratum", "clause", "passage").distinct()


def table_scores(read: DataFrame, printed: DataFrame) -> DataFrame:
    """(doc_id, page, a, b, score): how surely a table that a model read (doc_id, page, a, text, box, ref) is one that the page
    prints (doc_id, page, b, text, box, before): the share of common tokens, half the share of the smaller box that they have in
    common, and 0.3 if the number of its caption stands before the printed one or in its first line. Tables meet by page, of which each has a few."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0)))
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"_p.{hi}"), F.col(f"_q.{hi}")) - F.greatest(F.col(f"_p.{lo}"), F.col(f"_q.{lo}")))
    area = lambda c: (F.col(f"{c}.x1") - F.col(f"{c}.x0")) * (F.col(f"{c}.y1") - F.col(f"{c}.y0"))
    a = read.select("doc_id", "page", "a", tokens(F.col("text")).alias("_s"), F.col("box").alias("_p"), "ref")
    b = printed.select("doc_id", "page", "b", tokens(F.col("text")).alias("_t"), F.col("box").alias("_q"), F.concat_ws("\n", "before", F.split("text", "\n", 2)[0]).alias("_near"))
    common, every = F.size(F.array_intersect("_s", "_t")), F.size(F.array_union("_s", "_t"))
    share = F.coalesce(F.try_divide(common.cast("double"), every), F.lit(0.0))
    over = F.coalesce(0.5 * F.try_divide(side("x0", "x1") * side("y0", "y1"), F.least(area("_p"), area("_q"))), F.lit(0.0))
    quoted = F.concat(F.lit(r"(?i)\b\Q"), F.col("ref"), F.lit(r"\E\b"))
    caption = F.when(F.coalesce("ref", F.lit("")) == "", 0.0).otherwise(F.when(F.regexp_like("_near", quoted), 0.3).otherwise(0.0))
    return a.join(b, ["doc_id", "page"]).select("doc_id", "page", "a", "b", F.round(share + over + caption, 6).alias("score"))


def claim_once(scores: DataFrame, least: float = 0.5, margin: float = 0.15) -> DataFrame:
    """(doc_id, page, a, b, score): tables a take their printed ones b, one after the other, each b once: the best that is still
    free, if it scores ``least`` and ``margin`` more than the next. A fold over a page's tables."""
    own = scores.groupBy("doc_id", "page", "a").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "b"))).alias("bs"))
    g = own.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("a", "bs"))).alias("ts"))
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    start = F.array().cast(f"array<struct<a:{kinds['a']},b:{kinds['b']},score:double>>")

    def step(taken: Column, t: Column) -> Column:
        free = F.filter(t["bs"], lambda x: ~F.exists(taken, lambda k: k["b"] == x["b"]))
        best, second = F.get(free, F.lit(0)), F.get(free, F.lit(1))
        sure = F.coalesce((-best["minus"] >= least) & (second.isNull() | (-second["minus"] < -best["minus"] - margin)), F.lit(False))
        return F.when(sure, F.concat(taken, F.array(F.struct(t["a"].alias("a"), best["b"].alias("b"), (-best["minus"]).alias("score"))))).otherwise(taken)

    return g.select("doc_id", "page", F.explode(F.aggregate("ts", start, step)).alias("k")).select("doc_id", "page", "k.a", "k.b", "k.score")

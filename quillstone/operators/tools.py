"""Calls that tools make for questions, in batches: each stays within its question's scope, may narrow it to the documents of
one tag, and never widens it. A call that the scope leaves nothing gets a note in place of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import scopes, search
from quillstone.session import written


@dataclass
class Tagged:
    """Calls with a tag on the whole library, without a list for each: calls are call, tag; held are tag, doc_id, the current
    documents of these tags, once for all calls; changes are call, doc_id, used, where a call's question departs from them."""

    calls: DataFrame
    held: DataFrame
    changes: DataFrame

    def members(self) -> DataFrame:
        """(call, doc_id): the list for each call, which grows with calls times documents."""
        gone = self.changes.where(~F.col("used")).select("call", "doc_id")
        usual = self.calls.join(self.held, "tag").select("call", "doc_id").join(gone, ["call", "doc_id"], "left_anti")
        return usual.unionByName(self.changes.where("used").select("call", "doc_id"))


def permitted(calls: DataFrame, asks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, members): outcomes are call, note, n_docs; members are call, doc_id.

    calls: call (a key), ask, tag; asks and docs as for ``scopes.resolve``. Without a tag (null, blank) a call has its question's
    scope; of a question that may use the whole library it has null n_docs and no members. With a tag it has those documents of the
    scope that carry it, case aside. Notes: no_question; empty (the scope has no document); not_selected (no document that the
    user selected carries the tag); outside (the question names other tags, or the tagged documents are not of its domains);
    not_loaded (no current document carries the tag). Null where the call may go on."""
    outcomes, listed, tagged = scoped(calls, asks, docs)
    return outcomes, listed.unionByName(tagged.members())


def scoped(calls: DataFrame, asks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, Tagged]:
    """(outcomes, members, tagged): as ``permitted``, but calls with a tag on the whole library are in ``tagged``, not in members.

    Documents are counted for each question and tag, not for each call, and those of a tag in the whole library once: a question's
    count differs from that by its exceptions alone."""
    reasons, allowed = scopes.resolve(asks, docs)
    d = docs.dropDuplicates(["doc_id"])
    tags = d.select("doc_id", "superseded", "missing", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("_tag"))
    now = ~F.col("missing") & ~F.col("superseded")
    tag = F.nullif(F.lower(F.trim("tag")), F.lit(""))
    reasons = reasons.select("ask", "reason", F.transform("found", F.lower).alias("_found"), F.col("n_docs").alias("_scope"))
    c = written(calls.select("call", "ask", tag.alias("_tag")).join(reasons, "ask", "left"), "calls")
    allowed = written(allowed, "allowed")
    limited, tagged = F.col("reason") != "all", F.col("_tag").isNotNull()
    named = F.col("reason").isin("entity", "entity_missing")
    # A document may carry other tags than those that brought it into the scope: these do not count.
    counts = limited & (~tagged | ~named | F.array_contains("_found", F.col("_tag")))
    pairs = c.where(counts & tagged).select("ask", "_tag").distinct().join(allowed, "ask")
    narrow = written(pairs.join(tags.select("doc_id", "_tag"), ["doc_id", "_tag"], "left_semi").select("ask", "_tag", "doc_id"), "narrowed")
    known = tags.where(now).groupBy("_tag").agg(F.count("*").alias("_known"))
    changed = written(scopes.whole(asks, docs).join(tags.select("doc_id", "_tag"), "doc_id"), "changed")
    shift = changed.groupBy("ask", "_tag").agg(F.sum(F.when(F.col("used"), 1).otherwise(-1)).alias("_shift"))
    out = c.join(known, "_tag", "left").join(narrow.groupBy("ask", "_tag").agg(F.count("*").alias("_narrow")), ["ask", "_tag"], "left").join(shift, ["ask", "_tag"], "left")
    none = F.lit(0).cast("long")
    n = (
        F.when(limited & ~tagged, F.col("_scope")).when(counts, F.coalesce("_narrow", none))
        .when(~limited & tagged, F.coalesce("_known", none) + F.coalesce("_shift", none)).otherwise(none)
    )
    out = out.withColumn("n_docs", F.coalesce(n, none))
    note = (
        F.when(F.col("reason").isNull(), "no_question").when(F.col("n_docs") > 0, None).when(~tagged, F.when(limited, "empty"))
        .when(F.col("reason") == "user", "not_selected").when(named, "outside").when((F.col("_known") > 0) & limited, "outside").otherwise("not_loaded")
    )
    whole = (F.col("reason") == "all") & ~tagged
    outcomes = out.select("call", note.alias("note"), F.when(~whole | F.col("reason").isNull(), F.col("n_docs")).alias("n_docs"))
    members = c.where(counts & ~tagged).select("call", "ask").join(allowed, "ask").select("call", "doc_id")
    members = members.unionByName(c.where(counts & tagged).select("call", "ask", "_tag").join(narrow, ["ask", "_tag"]).select("call", "doc_id"))
    free = c.where(~limited & tagged).select("call", "ask", F.col("_tag").alias("tag"))
    held = tags.where(now).select(F.col("_tag").alias("tag"), "doc_id").join(free.select("tag").distinct(), "tag", "left_semi")
    changes = free.join(changed.withColumnRenamed("_tag", "tag"), ["ask", "tag"]).select("call", "doc_id", "used")
    return outcomes, members, Tagged(free.select("call", "tag"), held, changes)


def rows(calls: DataFrame, given: DataFrame, outcomes: DataFrame, members: DataFrame, k: int = 10, tagged: Tagged | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, unverified): found are call, row_id, score, rank, the k verified rows with most of the call's terms, ties to the lesser
    row_id; unverified are call, n_rows, rows that match but can't be cited.

    calls: call, terms (array). given: row_id (a key), doc_id, terms (array), verified. Calls that have a list of documents meet the
    rows of these; those that may use the whole library meet rows by equal terms, those of ``tagged`` by tag and term. In both,
    one of the terms may be common. Null terms match nothing; null verified is false."""
    distinct = lambda c: F.array_compact(F.array_distinct(c))
    term = lambda df, *more: df.select(*more, F.explode(distinct("terms")).alias("term"))
    given = given.withColumn("verified", F.coalesce("verified", F.lit(False)))
    listed = term(calls.join(members, "call"), "call", "doc_id").join(term(given, "row_id", "doc_id", "verified"), ["doc_id", "term"])
    met = listed.groupBy("call", "row_id").agg(F.max("verified").alias("verified"), F.count("*").alias("score"))
    good, bad = met.where("verified").drop("verified"), met.where(~F.col("verified")).groupBy("call").agg(F.count("*").alias("n_rows"))
    every = outcomes.where("note is null and n_docs is null").select("call")
    more, unverified = _common_rows(calls, given, every, tagged, k)
    good, bad = good.unionByName(more), bad.unionByName(unverified)
    return search.top(good, ["call"], [F.desc("score"), F.col("row_id")], k), bad


def _common_rows(calls: DataFrame, given: DataFrame, every: DataFrame, tagged: Tagged | None, k: int) -> tuple[DataFrame, DataFrame]:
    """(found, unverified): call, row_id, score of verified rows, the k best of each call among them, and call, n_rows, of calls
    (``every``) on all rows, whose tag is the empty one here, and of those on all documents of a tag.

    Rows are listed by tag and term once. Of the term that most of a tag's rows have, a call takes its first k rows only, and as many
    more as its question excludes: a later row that matches nothing else has k better ones before it. Rows of its other terms are all taken."""
    terms = F.array_compact(F.array_distinct("terms"))
    calls = calls.select("call", terms.alias("_terms"))
    given = given.select("row_id", "doc_id", "verified", terms.alias("_has"))
    score = F.size(F.array_intersect("_terms", "_has")).cast("long").alias("score")
    if tagged is None:
        none = calls.select("call", F.lit("").alias("tag"), F.lit(True).alias("used")).where("false").crossJoin(given.select("doc_id").where("false"))
        tagged = Tagged(none.select("call", "tag"), none.select("tag", "doc_id"), none.select("call", "doc_id", "used"))
    c = tagged.calls.unionByName(every.select("call", F.lit("").alias("tag"))).join(calls, "call")
    changes = tagged.changes.join(calls, "call").join(given, "doc_id").select("call", "row_id", "verified", "used", "_has", score)
    changes = written(changes.where("score > 0"), "changes")
    held = given.join(tagged.held, "doc_id").select("tag", "row_id", "verified", "_has")
    held = held.unionByName(given.select(F.lit("").alias("tag"), "row_id", "verified", "_has")).select("*", F.explode("_has").alias("term"))
    wanted = written(c.select("call", "tag", "_terms", F.explode("_terms").alias("term")), "tagged-terms")
    held = written(held.join(wanted.select("tag", "term").distinct(), ["tag", "term"], "left_semi"), "tagged-rows")
    sizes = held.groupBy("tag", "term").agg(F.count_if("verified").alias("_good"), F.count_if(~F.col("verified")).alias("_bad"))
    wanted = wanted.join(sizes, ["tag", "term"])
    star = wanted.groupBy("call").agg(F.max(F.struct(F.col("_good") + F.col("_bad"), "term", "tag", "_terms", "_good", "_bad")).alias("x"))
    star = written(star.select("call", F.col("x.term").alias("_star"), "x.tag", "x._terms", "x._good", "x._bad"), "commonest")
    out = changes.where(~F.col("used"))
    hidden = out.join(star.select("call", "_star"), "call").where(F.col("verified") & F.array_contains("_has", F.col("_star"))).groupBy("call").agg(F.count("*").alias("_hidden"))
    first = written(star.join(hidden, "call", "left").withColumn("_take", F.least("_good", k + F.coalesce("_hidden", F.lit(0)))), "first")
    most = first.agg(F.max("_take")).first()[0] or 0  # one number
    heads = held.where("verified").join(first.select("tag", F.col("_star").alias("term")).distinct(), ["tag", "term"], "left_semi")
    heads = search.top(heads, ["tag", "term"], [F.col("row_id")], most).select("tag", F.col("term").alias("_star"), F.col("rank").alias("_at"), "row_id", "_has")
    asked = first.where("_take > 0").select("call", "tag", "_star", "_terms", F.explode(F.sequence(F.lit(1).cast("long"), "_take")).alias("_at"))
    common = asked.join(heads, ["tag", "_star", "_at"]).select("call", "row_id", score)
    rare = wanted.select("call", "tag", "term", "_terms").join(star.select("call", "_star"), "call").where(F.col("term") != F.col("_star"))
    rare = rare.join(held, ["tag", "term"]).select("call", "row_id", "verified", F.array_contains("_has", F.col("_star")).alias("_both"), score).distinct()
    usual = common.unionByName(rare.where("verified").select("call", "row_id", "score")).distinct().join(out.select("call", "row_id"), ["call", "row_id"], "left_anti")
    found = usual.unionByName(changes.where("used and verified").select("call", "row_id", "score"))
    n = star.select("call", F.col("_bad").alias("n")).unionByName(rare.where(~F.col("verified") & ~F.col("_both")).select("call", F.lit(1).cast("long").alias("n")))
    n = n.unionByName(changes.where(~F.col("verified")).select("call", F.when(F.col("used"), 1).otherwise(-1).cast("long").alias("n")))
    return found, n.groupBy("call").agg(F.sum("n").alias("n_rows")).where("n_rows > 0")

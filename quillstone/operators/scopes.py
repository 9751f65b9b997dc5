"""The documents that each of many questions may use, by joins on keys: no question meets a document it has no key of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = F.array


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _keys(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("key")))


def pins(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """asks with _pins: the identities of the documents of which the question names a revision."""
    named = asks.select("ask", F.explode("revisions").alias("doc_id")).join(docs.select("doc_id", "identity"), "doc_id")
    return asks.join(named.groupBy("ask").agg(F.collect_set("identity").alias("_pins")), "ask", "left").withColumn("_pins", _texts("_pins"))


def usable() -> Column:
    """Not missing, and either of a revision that the question names, or neither superseded nor another revision of such a document."""
    named = F.array_contains("revisions", F.col("doc_id"))
    other = (F.col("doc_type") == "base") & F.array_contains("_pins", F.col("identity"))
    return F.coalesce(~F.col("missing") & (F.coalesce(named, F.lit(False)) | (~F.coalesce(other, F.lit(False)) & ~F.col("superseded"))), F.lit(False))


def resolve(asks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scopes, members): scopes are ask, reason, found, absent (named entities with and without a document), skipped (selected
    documents whose file is gone) and n_docs; members are ask, doc_id.

    asks: ask, and arrays buckets, doc_ids, domains, entities, routed, revisions (documents of which the question names the
    revision). docs: doc_id, bucket, domain, entities (array), identity, doc_type, superseded, missing. Null and empty arrays are
    no limit. The first limit decides where documents come from: buckets with the selected documents; the selected ones; domains;
    named entities; domains that the question was routed to. Named entities also narrow the first three, case aside, by whole
    tags. The reason is entity or entity_missing where entities are named, else user for the first three, domain for the last.
    Selected documents need not be current, but their file must be there; if none is left, the scope is empty. A question
    without limit, or routed to domains without a document, has reason all, null n_docs and no members: it may use every document
    that is current, and ``whole`` takes these. Rows that repeat a document count once, null keys match nothing, ask is a key.

    Questions and documents meet by equal keys, so the rows between are those of the scopes themselves, for hot keys too."""
    arrays = {c: F.coalesce(c, F.array().cast(asks.schema[c].dataType)) for c in ("buckets", "doc_ids", "domains", "routed", "revisions")}
    a = asks.select("ask", *[v.alias(c) for c, v in arrays.items()], F.array_distinct(F.array_compact(_texts("entities"))).alias("entities"))
    a = a.withColumn("_lower", F.array_distinct(F.transform("entities", F.lower)))
    d = docs.select("doc_id", "bucket", "domain", F.array_distinct(F.transform(_texts("entities"), F.lower)).alias("_tags"), "identity", "doc_type", "superseded", "missing").dropDuplicates(["doc_id"])
    selected = a.select("ask", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).join(d.select("doc_id", "missing"), "doc_id")
    gone = selected.groupBy("ask").agg(F.count_if("missing").alias("_gone"), F.count_if(~F.col("missing")).alias("_there"))
    a = pins(a, d).join(gone, "ask", "left").na.fill(0, ["_gone", "_there"])
    some = lambda c: F.size(c) > 0
    # Selected documents that were never there are kept as a selection: it is empty then.
    mode = (
        F.when(some("buckets"), "bucket").when(some("doc_ids"), "doc").when(some("domains"), "domain")
        .when(some("entities"), "entity").when(some("routed"), "routed").otherwise("all")
    )
    a = a.withColumn("_mode", mode)
    is_ = lambda *m: F.col("_mode").isin(*m)
    wanted = F.concat(
        F.when(is_("bucket"), _keys("bucket", F.col("buckets"))).otherwise(_keys("", _NONE())), F.when(is_("bucket", "doc"), _keys("doc", F.col("doc_ids"))).otherwise(_keys("", _NONE())),
        F.when(is_("domain"), _keys("domain", F.col("domains"))).when(is_("routed"), _keys("domain", F.col("routed"))).otherwise(_keys("", _NONE())),
        F.when(is_("entity"), _keys("entity", F.col("_lower"))).otherwise(_keys("", _NONE())),
    )
    has = F.concat(_keys("bucket", F.array("bucket")), _keys("doc", F.array("doc_id")), _keys("domain", F.array("domain")), _keys("entity", F.col("_tags")))
    asked = a.select("ask", "_mode", "_lower", "revisions", "_pins", F.explode(F.array_distinct(wanted)).alias("k")).select("*", "k.*").drop("k")
    held = d.select("*", F.explode(has).alias("k")).select("*", "k.*").drop("k", "bucket", "domain")
    met = asked.join(held, ["kind", "key"]).where(F.when(F.col("kind") == "doc", ~F.col("missing")).otherwise(usable()))
    met = met.withColumn("_hit", F.array_intersect("_lower", "_tags")).where((F.size("_lower") == 0) | (F.size("_hit") > 0))
    members = met.groupBy("ask", "doc_id").agg(F.first("_hit").alias("_hit"))
    per = members.groupBy("ask").agg(F.count("*").alias("_n"), F.array_distinct(F.flatten(F.collect_set("_hit"))).alias("_found"))
    out = a.join(per, "ask", "left").withColumn("_found", _texts("_found"))
    n = F.coalesce("_n", F.lit(0))
    # A selection of which nothing is left is the user's, whatever entities are named.
    emptied = is_("doc") & (F.col("_gone") > 0) & (F.size(F.array_distinct("doc_ids")) == F.col("_gone"))
    reason = (
        F.when(is_("all") | (is_("routed") & (n == 0)), "all").when(is_("routed"), "domain").when(emptied, "user")
        .when(some("entities"), F.when(n > 0, "entity").otherwise("entity_missing")).otherwise("user")
    )
    named = lambda there: F.when(is_("all", "routed") | emptied, _NONE().cast("array<string>")).otherwise(F.filter("entities", lambda e: F.array_contains("_found", F.lower(e)) == there))
    scopes = out.select("ask", reason.alias("reason"), named(True).alias("found"), named(False).alias("absent"), F.col("_gone").alias("skipped"))
    scopes = scopes.join(per.select("ask", "_n"), "ask", "left").withColumn("n_docs", F.when(F.col("reason") != "all", F.coalesce("_n", F.lit(0)))).drop("_n")
    return scopes, members.select("ask", "doc_id")


def whole(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """(ask, doc_id, used): where a question of reason all departs from the current documents: revisions that it names though
    they are superseded (used), and other revisions of those documents (not used). All other current documents are the same
    for every question, so they are never listed for each. asks: ask, revisions; docs as for ``resolve``."""
    d = docs.dropDuplicates(["doc_id"])
    p = pins(asks.select("ask", F.coalesce("revisions", F.array().cast(asks.schema["revisions"].dataType)).alias("revisions")), d)
    near = p.select("*", F.explode("_pins").alias("identity")).join(d, "identity")
    near = near.withColumn("used", usable()).withColumn("_now", ~F.col("missing") & ~F.col("superseded"))
    return near.where(F.col("used") != F.col("_now")).select("ask", "doc_id", "used").distinct()

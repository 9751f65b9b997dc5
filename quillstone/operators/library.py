"""Library upkeep: snapshots, upserts, change plans, supersedence, conflicts and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.bounds import numbered


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: list[Column]) -> DataFrame:
    """One row for each key: the newest of both sides."""
    w = Window.partitionBy(*keys).orderBy(*recency)
    return old.unionByName(new, allowMissingColumns=True).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def delete_cascade(victims: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Every table without the rows of the victims."""
    return [t.join(victims.select(key).distinct(), key, "left_anti") for t in tables]


def keep_last(runs: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return runs.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def replace_partition(table: DataFrame, path: str, by: str) -> None:
    """Writes a snapshot's partitions over those that are there; others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def clone(rows: DataFrame, id_col: str, first_id: int, order: list[Column], **changes) -> DataFrame:
    """Copies of rows under new ids from first_id on."""
    out = numbered(rows, order, "_nth")
    out = out.withColumn(id_col, (F.lit(first_id) + F.col("_nth")).cast("long")).drop("_nth")
    return out.withColumns({k: F.lit(v) for k, v in changes.items()})


def two_libraries(shared: DataFrame, personal: DataFrame, ids: list[str], shift: int = 10**9) -> DataFrame:
    """Both as one view, the second's ids shifted."""
    return shared.unionByName(personal.withColumns({c: F.col(c) + shift for c in ids}), allowMissingColumns=True)


def change_plan(files: DataFrame, docs: DataFrame, fingerprint: str, unreadable: list[str] | None = None) -> DataFrame:
    """(rel, action, doc_id, from_doc): what a sync would do.

    files: rel, size, mtime, sha. docs: doc_id, rel, size, mtime, sha, fp, missing. Same size and time count as the same
    content; else the hash decides. A file that is new here, with the content of a document whose file is
    gone, is a move: each such document is used once, in order of path and id. With the content of one that
    is there still, it is a duplicate. Documents below an unreadable folder are unreachable, not missing.
    """
    d = docs.select(*[F.col(c).alias("d_" + c) for c in docs.columns])
    both = files.join(d, files["rel"] == F.col("d_rel"), "full_outer")
    current = lambda fp: (F.coalesce(fp, F.lit("")) == "") | (fp == fingerprint)
    same_stat = (F.col("size") == F.col("d_size")) & (F.col("mtime") == F.col("d_mtime"))
    same_sha = F.col("sha") == F.col("d_sha")
    state = (
        F.when(F.col("d_rel").isNull(), "new")
        .when(F.col("rel").isNull(), "gone")
        .when(~same_stat & ~same_sha, "changed")
        .when(~current(F.col("d_fp")), "settings")
        .when(~same_stat, "touched")
        .when(F.col("d_missing"), "restored")
        .otherwise("unchanged")
    )
    both = both.withColumn("state", state)
    nth = lambda order: F.row_number().over(Window.partitionBy("key").orderBy(*order))
    new = both.where("state = 'new'").select("rel", F.col("sha").alias("key")).withColumn("nth", nth(["rel"]))
    gone = both.where(F.col("state") == "gone").where(current(F.col("d_fp"))).select(F.col("d_doc_id").alias("g_doc"), F.col("d_sha").alias("key")).withColumn("nth", nth(["g_doc"]))
    moved = new.join(gone, ["key", "nth"]).select(F.col("rel").alias("m_rel"), F.col("g_doc").alias("from_doc"))
    live = d.where(~F.col("d_missing") & current(F.col("d_fp"))).groupBy("d_sha").agg(F.max("d_doc_id").alias("dup_doc")).withColumnRenamed("d_sha", "l_sha")
    out = both.join(moved, both["rel"] == F.col("m_rel"), "left").join(live, both["sha"] == F.col("l_sha"), "left")
    used = moved.select(F.col("from_doc").alias("used"))
    out = out.join(used, (out["d_doc_id"] == F.col("used")) & (F.col("state") == "gone"), "left_anti")
    is_new = F.col("state") == "new"
    below = F.lit(False)
    for prefix in unreadable or []:
        below = below | F.col("d_rel").startswith(prefix)
    action = (
        F.when(is_new & F.col("from_doc").isNotNull(), "moved")
        .when(is_new & F.col("dup_doc").isNotNull(), "duplicate")
        .when((F.col("state") == "gone") & below, "unreachable")
        .when(F.col("state") == "gone", "missing")
        .otherwise(F.col("state"))
    )
    source = F.when(is_new, F.coalesce("from_doc", "dup_doc"))
    return out.select(F.coalesce("rel", "d_rel").alias("rel"), action.alias("action"), F.col("d_doc_id").alias("doc_id"), source.alias("from_doc"))


def revision_key(rev: Column) -> Column:
    """Sorts revisions in natural order: runs of digits by value and before letters, runs of letters by name."""
    parts = F.regexp_extract_all(F.coalesce(rev, F.lit("")), F.lit(r"\d+|[a-zA-Z]+"), F.lit(0))
    number = lambda p: p.rlike(r"^\d+$")
    return F.transform(parts, lambda p: F.struct(F.when(number(p), 0).otherwise(1).alias("k"), F.when(number(p), p.try_cast("long")).otherwise(0).alias("n"), F.when(number(p), "").otherwise(F.lower(p)).alias("s")))


def revision_style(rev: Column) -> Column:
    """number or letter; revisions of different styles have no order."""
    return F.when(F.regexp_extract(F.coalesce(rev, F.lit("")), r"(\d+|[a-zA-Z]+)", 1).rlike(r"^\d"), "number").otherwise("letter")


def supersedence(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, superseded_by): docs have doc_id, doc_date, revision and the keys of one series.

    Dates decide if all members have one, then revisions; else revisions alone, if all have one in one
    style; else nothing. A tie for the newest leaves the group as it is. A group of one has no newest.
    """
    g = Window.partitionBy(*keys)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    d = docs.withColumn("_n", F.count("*").over(g)).withColumn("_dated", F.min(has("doc_date")).over(g)).withColumn("_revised", F.min(has("revision")).over(g))
    style = revision_style(F.col("revision"))
    d = d.withColumn("_styles", F.size(F.collect_set(style).over(g)))
    key = F.struct(F.when(F.col("_dated"), F.col("doc_date")).otherwise("").alias("d"), revision_key(F.col("revision")).alias("r"))
    d = d.withColumn("_key", key).withColumn("_top", F.max("_key").over(g))
    d = d.withColumn("_tops", F.sum((F.col("_key") == F.col("_top")).cast("int")).over(g)).withColumn("_newest", F.max(F.when(F.col("_key") == F.col("_top"), F.col("doc_id"))).over(g))
    decided = (F.col("_n") > 1) & (F.col("_dated") | (F.col("_revised") & (F.col("_styles") == 1))) & (F.col("_tops") == 1)
    return d.select("doc_id", F.when(decided & (F.col("doc_id") != F.col("_newest")), F.col("_newest")).alias("superseded_by"))


def amendment_targets(docs: DataFrame) -> DataFrame:
    """(doc_id, target): base documents that an erratum, a change notice or an amendment applies to.

    docs: doc_id, doc_type, domain, series, version, superseded_by. With a version stated: bases of that
    version, or without one, current ones if there are any. Without: the only current base of the series.
    """
    a = docs.where(F.col("doc_type").isin("errata", "ecn", "amendment")).select(F.col("doc_id").alias("a_id"), "domain", "series", F.coalesce("version", F.lit("")).alias("a_ver"))
    b = docs.where("doc_type = 'base' and series <> ''").select(F.col("doc_id").alias("target"), "domain", "series", F.coalesce("version", F.lit("")).alias("ver"), F.col("superseded_by").isNull().alias("active"))
    pairs = a.join(b, ["domain", "series"]).where((F.col("a_ver") == "") | F.col("ver").isin("") | (F.col("ver") == F.col("a_ver")))
    g = Window.partitionBy("a_id")
    pairs = pairs.withColumn("n_active", F.sum(F.col("active").cast("int")).over(g))
    fine = F.when(F.col("a_ver") != "", F.col("active") | (F.col("n_active") == 0)).otherwise(F.col("active") & (F.col("n_active") == 1))
    return pairs.where(fine).select(F.col("a_id").alias("doc_id"), "target")


def condition_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), " ")


def conflicts(params: DataFrame) -> DataFrame:
    """(name, cond, docs, variants, shown): parameters of one name and condition that several documents give
    different values for. params: doc_id, name, conditions, min, typ, max, unit."""
    value = F.struct("min", "typ", "max", "unit")
    shown = F.concat_ws(" ", F.coalesce("min", "typ", "max"), "unit")
    g = params.groupBy(F.lower(F.trim("name")).alias("name"), condition_tokens(F.col("conditions")).alias("cond"))
    out = g.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct(value).alias("variants"), F.array_join(F.array_sort(F.collect_set(shown)), " vs ").alias("shown"))
    return out.where("docs > 1 and variants > 1")


def scope(docs: DataFrame, buckets: list[str] | None, doc_ids: list[int] | None, domains: list[str] | None, entities: list[str] | None, routed: list[str] | None) -> DataFrame:
    """(doc_id, reason) of the documents that a question may use. The first of these that applies: the user's
    buckets with the selected documents, the selected documents, domains, named entities (case aside, whole
    tags), routed domains (if any document is in them), all. An empty list matches nothing; None is no limit.
    docs: doc_id, bucket, domain, entities (array), superseded, missing."""
    usable = docs.where("not missing and not superseded")
    wanted = F.array(*[F.lit(e.lower()) for e in entities]) if entities else None
    tagged = F.exists("entities", lambda e: F.array_contains(wanted, F.lower(e))) if entities else F.lit(True)
    out = lambda df, why: df.select("doc_id", F.lit(why).alias("reason"))
    if buckets is not None:
        chosen = F.col("bucket").isin(buckets) | (F.col("doc_id").isin(doc_ids) if doc_ids else F.lit(False))
        return out(usable.where(chosen & tagged), "user")
    if doc_ids is not None:
        return out(usable.where(F.col("doc_id").isin(doc_ids) & tagged), "user")
    pool = usable.where(F.col("domain").isin(domains)) if domains is not None else usable
    if domains is not None and not entities:
        return out(pool, "user")
    if entities:
        return out(pool.where(tagged), "entity")
    if routed:
        n = pool.agg(F.count_if(F.col("domain").isin(routed)).alias("_n"))
        marked = pool.join(F.broadcast(n))  # one row
        return marked.where(F.col("domain").isin(routed) | (F.col("_n") == 0)).select("doc_id", F.when(F.col("_n") > 0, "domain").otherwise("all").alias("reason"))
    return out(pool, "all")


def overlay(settings: DataFrame, key: str, layer: str, at: str, value: str) -> DataFrame:
    """The newest decision for each key; of equal times the higher layer."""
    best = F.max_by(F.struct(value, layer), F.struct(at, layer))
    return settings.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b").getField(value).alias(value), F.col("_b").getField(layer).alias(layer))


def number_sources(rows: DataFrame, by: list[str], key: str, arrival: str) -> DataFrame:
    """Adds n: a dense number from 1 for each key, in order of first arrival."""
    first = rows.withColumn("_first", F.min(arrival).over(Window.partitionBy(*by, key)))
    return first.withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")).cast("long")).drop("_first")


def mirror(remote: DataFrame, local: DataFrame, key: str, version: list[str]) -> DataFrame:
    """(key, action): copy what is new or of another version, remove what the remote has no more, keep the rest."""
    r = remote.select(F.col(key), F.struct(*version).alias("_r"))
    own = local.select(F.col(key), F.struct(*version).alias("_l"))
    action = F.when(F.col("_r").isNull(), "remove").when(F.col("_l").isNull() | ~F.col("_r").eqNullSafe(F.col("_l")), "copy").otherwise("keep")
    return r.join(own, key, "full_outer").select(key, action.alias("action"))


def compatible(manifest: DataFrame, model: str, dim: int) -> None:
    """An error, if vectors of another model or length than the current one are stored (manifest: model, dim)."""
    other = manifest.where((F.col("model") != model) | (F.col("dim") != dim)).select("model", "dim").limit(1).collect()
    if other:
        raise ValueError(f"the library's vectors are of {other[0]['model']} ({other[0]['dim']}), not of {model} ({dim}): make them anew")


def relink(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new side by side where a key stands once on either side; null keys, and those that repeat, link nothing."""

    def single(d: DataFrame) -> DataFrame:
        rest = [c for c in d.columns if c != key]
        return d.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r")).where("_n = 1").select(key, "_r.*")

    return single(old).join(single(new), key)

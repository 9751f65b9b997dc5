"""What an intake does to a library's tables: replaces, moves, purges, reuses, classifies and tags."""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx


def replace_rows(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the incoming keys replaced by the incoming rows. With an empty incoming table
    nothing goes. One call for each table of a document makes the replacement whole."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def bulk_update(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """rows with the values of updates (key and some of rows' columns) where it has any; nulls change nothing."""
    new = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in updates.columns if c != key])
    out = rows.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in updates.columns and c != key else F.col(c) for c in rows.columns])


def migrate(rows: DataFrame, columns: dict[str, object], version: Column, current: int) -> DataFrame:
    """Rows of any format with all columns of the current one: what they lack takes its default, and what older
    formats call verified is not taken over."""
    out = rows.withColumns({c: F.lit(v) for c, v in columns.items() if c not in rows.columns})
    return out.withColumn("verified", F.coalesce(F.col("verified"), F.lit(False)) & (version >= current))


def apply_plan(docs: DataFrame, plan: DataFrame, files: DataFrame) -> DataFrame:
    """The documents after a change plan (rel, action, doc_id, from_doc): (doc_id, rel, size, mtime, missing, todo).

    A move takes the new path and keeps the document; touched and restored ones take the file's time and size; what
    is missing is marked, not deleted. todo is what remains for the parser: new, changed, settings, or duplicate
    (whose rows are cloned). New files have no id yet."""
    p = plan.select(F.col("rel").alias("p_rel"), "action", F.when(F.col("action") == "moved", F.col("from_doc")).otherwise(F.col("doc_id")).alias("p_doc"))
    f = files.select(F.col("rel").alias("f_rel"), F.col("size").alias("f_size"), F.col("mtime").alias("f_mtime"))
    both = docs.select("doc_id", "rel", "size", "mtime", "missing").join(p, F.col("doc_id") == F.col("p_doc"), "full_outer").join(f, F.col("p_rel") == F.col("f_rel"), "left")
    action = F.col("action")
    taken = action.isin("moved", "touched", "restored", "new", "duplicate")
    return both.select(
        "doc_id", F.coalesce("p_rel", "rel").alias("rel"), F.when(taken, F.col("f_size")).otherwise(F.col("size")).alias("size"), F.when(taken, F.col("f_mtime")).otherwise(F.col("mtime")).alias("mtime"),
        (F.coalesce(action == "missing", F.lit(False)) | (F.coalesce(action.isin("unchanged", "settings", "unreachable") | action.isNull(), F.lit(False)) & F.coalesce("missing", F.lit(False)))).alias("missing"),
        F.when(action.isin("new", "changed", "settings", "duplicate"), action).alias("todo"),
    )


def purge_missing(docs: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """docs without the missing ones, and every table (doc_id) without their rows."""
    gone = docs.where("missing").select("doc_id")
    return [docs.where("not missing"), *(t.join(gone, "doc_id", "left_anti") for t in tables)]


def reuse_embeddings(chunks: DataFrame, old: DataFrame) -> DataFrame:
    """chunks (doc_id, ordinal, section, kind, text) with the embedding of an old chunk of the same document, section,
    kind and text, or null where it has to be made. Of several old ones the first counts."""
    same = F.sha2(F.concat_ws("\x1f", F.coalesce("section", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    kept = old.select(F.col("doc_id").alias("_doc"), same.alias("_same"), F.struct("ordinal", "embedding").alias("_e")).groupBy("_doc", "_same").agg(F.min_by("_e.embedding", "_e.ordinal").alias("embedding"))
    return chunks.join(kept, (F.col("doc_id") == F.col("_doc")) & (same == F.col("_same")), "left").drop("_doc", "_same")


def not_cached(todo: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a cache (keys, ...) has no result for."""
    return todo.join(cache.select(*keys).distinct(), keys, "left_anti")


def dictionary(text: str) -> dict:
    """A YAML dictionary of collections: {domains: {key: {name, folders, patterns, glossary, entities}}, terms}. Missing
    parts are empty; the general collection is always there. A file of some hundred entries, read on the driver."""
    raw = yaml.safe_load(text) or {}
    names = lambda x: [] if x is None else [str(v) for v in (x if isinstance(x, list) else [x])]
    out = {}
    for key, spec in (raw.get("domains") or {}).items():
        spec = spec or {}
        entities = {str(e["id"]): names(e.get("patterns")) for e in spec.get("entities") or []}
        out[str(key)] = {"name": str(spec.get("name", key)), "folders": names(spec.get("folders")), "patterns": names(spec.get("patterns")), "glossary": {str(k): str(v) for k, v in (spec.get("glossary") or {}).items()}, "entities": entities}
    out.setdefault("general", {"name": "General", "folders": [], "patterns": [], "glossary": {}, "entities": {}})
    return {"domains": out, "terms": {str(k): str(v) for k, v in (raw.get("terms") or {}).items()}}


def _hits(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in patterns), F.lit(0))


def _best(text: Column, domains: dict, least: int) -> Column:
    """The collection whose patterns the text has most, ``least`` times or more; of equals the first."""
    scores = [F.struct(_hits(text, d["patterns"] + sum(d["entities"].values(), [])).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("key")) for i, (k, d) in enumerate(domains.items())]
    top = F.array_max(F.array(*scores))
    return F.when(top["n"] >= least, top["key"])


def classify(path: Column, sample: Column, words: dict) -> Column:
    """A file's collection: of its first folder (one of its own, where no collection has it), else by its name, else
    by its content, three hits or more; else general."""
    domains = words["domains"]
    folder = F.when(F.contains(path, F.lit("/")), F.lower(F.substring_index(path, "/", 1)))
    known = F.coalesce(*[F.when(folder.isin([f.lower() for f in [k, *d["folders"]]]), k) for k, d in domains.items()])
    made = F.regexp_replace(F.regexp_replace(folder, "[^a-z0-9_-]+", "_"), "^_+|_+$", "")
    stem = F.translate(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""), "_", " ")
    return F.coalesce(known, F.nullif(made, F.lit("")), F.when(folder.isNotNull(), "general"), _best(stem, domains, 1), _best(sample, domains, 3), F.lit("general"))


def entities_of(head: Column, front: Column, words: dict, domain: Column | None = None) -> Column:
    """The standards that a document is about: those that its name or title has; else those of its first pages that are
    named twice or more, and at least 0.6 times as often as the most frequent one. Most frequent first."""
    every = [(e, p, k) for k, d in words["domains"].items() for e, p in d["entities"].items()]
    if not every:
        return F.array().cast("array<string>")
    own = lambda k: F.lit(True) if domain is None else (domain == k) | ~domain.isin([x for x, d in words["domains"].items() if d["entities"]])
    counted = lambda text, ok: F.array_sort(F.filter(F.array(*[F.struct((-F.when(ok(k), _hits(text, p)).otherwise(0)).alias("n"), F.lit(i).alias("o"), F.lit(e).alias("e")) for i, (e, p, k) in enumerate(every)]), lambda x: x["n"] < 0))
    ids = lambda a: F.transform(a, lambda x: x["e"])
    strong, wide, weak = counted(head, own), counted(head, lambda k: F.lit(True)), counted(front, own)
    most = -F.coalesce(F.get(weak, F.lit(0))["n"], F.lit(0))
    dominant = F.filter(weak, lambda x: -x["n"] >= F.greatest(F.lit(2), 0.6 * most))
    return F.when(F.size(strong) > 0, ids(strong)).when(F.size(wide) > 0, ids(wide)).otherwise(ids(dominant))


# Endings of short Turkish words, and how a last consonant softens before an ending.
ENDINGS = ["i", "u", "e", "a", "si", "su", "yi", "yu", "ye", "ya", "in", "un", "nin", "nun", "de", "da", "te", "ta", "den", "dan", "ten", "tan", "ler", "lar", "leri", "lari"]
SOFT = {"k": "g", "p": "b", "t": "d"}


def _term(word: str) -> str:
    """A pattern of a folded word with its endings: any for words of over four letters."""
    stem = r"\Q" + word[:-1] + r"\E" + (f"[{word[-1]}{SOFT[word[-1]]}]" if word[-1] in SOFT else r"\Q" + word[-1] + r"\E")
    return rf"(?<![a-z0-9]){stem}" + (rf"(?:{'|'.join(ENDINGS)})?(?![a-z0-9])" if len(word) <= 4 else "")


def _acronym(name: str) -> str:
    return ("" if len(name) <= 3 else "(?i)") + rf"(?<![A-Za-z0-9])\Q{name}\E(?![A-Za-z0-9])"


def expansions(text: Column, words: dict) -> Column:
    """The terms that a question implies: translations of its words, in whatever case and ending, then its acronyms
    with what they stand for; each once, in the dictionary's order."""
    fold = str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)
    terms = [F.when(tx.fold(text).rlike(_term(k.translate(fold).lower())), v) for k, v in words["terms"].items()]
    short = [F.when(text.rlike(_acronym(k)), f"{k} {v}") for d in words["domains"].values() for k, v in d["glossary"].items()]
    return F.array_distinct(F.array_compact(F.array(*terms, *short))) if terms or short else F.array().cast("array<string>")


def hints(text: Column, words: dict, domains: list[str] | None = None) -> Column:
    """'acronym = meaning' for the acronyms of the text, of the given collections (all, if none is given)."""
    found = [F.when(text.rlike(_acronym(k)), f"{k} = {v}") for key, d in words["domains"].items() if not domains or key in domains for k, v in d["glossary"].items()]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
